"""Queries of deduplication, similarity, ranks, metrics, rank aggregation and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.functions.hashing import hash_order, ratio_unit
from folioflow.operators import calibration, dedup, fusion, metrics, ranks, similarity
from folioflow.plans.table_queries import _TERMS, _TKEY, PAPERS_SQL, pair_outcomes, papers, verdicts
from folioflow.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- deduplication and splits ----

_CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.sha2(text.clean_text(F.col("text"), None), 256).alias("digest"))


@_query("d01_exact_groups", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({_CLEAN_SQL})) AS \"group\", count(*) OVER (PARTITION BY sha256({_CLEAN_SQL})) AS size FROM documents WHERE text IS NOT NULL")
def d01(spark, folder):
    """Documents of the same cleaned text."""
    return dedup.exact_groups(_cleaned(spark, folder), "doc_id", "digest")


_SPLIT_SQL = "CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'validation' ELSE 'train' END"


def leak_free(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cleaned, grouped by exact text, each group to one split by hash: rows and groups per split and kind."""
    groups = dedup.exact_groups(_cleaned(spark, folder), "doc_id", "digest")
    split = dedup.split_groups(groups, "doc_id", "group", None, "42")
    kinds = table(spark, folder, "documents").select("doc_id", "doc_kind")
    return split.join(kinds, "doc_id").groupBy("split", "doc_kind").agg(F.count("*").alias("documents"), F.count_distinct("group").alias("groups"))


QUERIES["d06_leak_free_split"] = leak_free
ORACLE["d06_leak_free_split"] = f"""
    SELECT {_SPLIT_SQL} AS split, doc_kind, count(*) AS documents, count(DISTINCT g) AS groups
    FROM (SELECT *, ('0x' || substr(sha256('42' || chr(0) || g::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS u
          FROM (SELECT doc_id, doc_kind, min(doc_id) OVER (PARTITION BY sha256({_CLEAN_SQL})) AS g FROM documents WHERE text IS NOT NULL)) GROUP BY ALL"""

_TT = _TKEY.replace("array_to_string(", "", 1).rpartition(", ' ')")[0]


def title_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct sets of title tokens, named by their smallest case."""
    t = table(spark, folder, "cases").filter("case_id is not null").select("case_id", F.array_sort(F.array_distinct(text.title_tokens(F.col("manuscript.title")))).alias("tokens")).filter("size(tokens) > 0")
    return t.groupBy("tokens").agg(F.min("case_id").alias("id")).select("id", "tokens")


_SETS_SQL = f"(SELECT min(case_id) AS id, t FROM (SELECT case_id, list_sort(list_distinct({_TT.format('manuscript.title')})) AS t FROM cases WHERE case_id IS NOT NULL AND manuscript.title IS NOT NULL) WHERE len(t) > 0 GROUP BY t)"
_LINKS_SQL = f"(SELECT a, b, jaccard FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t)) AS jaccard FROM {_SETS_SQL} x JOIN {_SETS_SQL} y ON x.id < y.id AND list_has_any(x.t[1:8], y.t[1:8])) WHERE jaccard >= 0.8)"


@_query("j19_near_duplicate_links", f"SELECT a, b, round(jaccard, 6) AS jaccard FROM {_LINKS_SQL}")
def j19(spark, folder):
    """Title sets at least 0.8 alike that share one of the first eight sorted tokens, between class representatives."""
    return _rounded(dedup.jaccard_links(title_sets(spark, folder), 0.8, 8), "jaccard")


@_query("j19_membership", f"SELECT case_id, s.id AS id FROM (SELECT DISTINCT case_id, list_sort(list_distinct({_TT.format('manuscript.title')})) AS t FROM cases WHERE case_id IS NOT NULL AND manuscript.title IS NOT NULL) c JOIN {_SETS_SQL} s ON s.t = c.t")
def j19_membership(spark, folder):
    """Which case bears which title set."""
    t = table(spark, folder, "cases").filter("case_id is not null").select("case_id", F.array_sort(F.array_distinct(text.title_tokens(F.col("manuscript.title")))).alias("tokens"))
    return t.join(title_sets(spark, folder), "tokens").select("case_id", "id").distinct()


@_query(
    "d04_duplicate_components",
    f"""WITH RECURSIVE m AS (SELECT DISTINCT case_id, source.forum_id AS f, list_sort(list_distinct({_TT.format("manuscript.title")})) AS t FROM cases WHERE case_id IS NOT NULL),
        e AS (SELECT x.case_id AS u, y.case_id AS v FROM m x JOIN m y ON x.f = y.f AND x.f <> '' UNION SELECT x.case_id, y.case_id FROM m x JOIN m y ON x.t = y.t AND len(x.t) > 0 UNION SELECT a, b FROM {_LINKS_SQL} UNION SELECT b, a FROM {_LINKS_SQL}),
        r AS (SELECT case_id AS u, case_id AS v FROM m UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
        SELECT u AS case_id, min(v) AS "group" FROM r GROUP BY 1""",
)
def d04(spark, folder):
    """The transitive closure of equal forums and alike titles."""
    t = table(spark, folder, "cases").select("case_id", F.col("source.forum_id").alias("forum"), F.array_distinct(text.title_tokens(F.col("manuscript.title"))).alias("tokens"))
    return dedup.duplicate_groups(t, "case_id", ["forum"], "tokens", 0.8, 8)


@_query("l04_hash_split", "SELECT paper_id, ('0x' || substr(sha256('7:' || paper_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.1 AS validation FROM proreview")
def l04(spark, folder):
    """One paper in ten to validation, by the hash of its id."""
    return table(spark, folder, "proreview").select("paper_id", (ratio_unit(F.col("paper_id"), "7") < 0.1).alias("validation"))


@_query("l06_temporal_split", f"SELECT CASE WHEN year <= 2024 THEN 'train' WHEN year = 2025 THEN 'validation' WHEN year > 2025 THEN 'test' END AS split, count(*) AS papers, count_if(label = 1) AS accepted FROM {PAPERS_SQL} GROUP BY 1")
def l06(spark, folder):
    """Papers by year to splits."""
    y = F.col("year")
    return papers(spark, folder).groupBy(F.when(y <= 2024, "train").when(y == 2025, "validation").when(y > 2025, "test").alias("split")).agg(F.count("*").alias("papers"), F.count_if(F.col("label") == 1).alias("accepted"))


@_query("l08_orientation", "SELECT pair_id, CASE WHEN n % 2 = 1 THEN b_id ELSE a_id END AS first_id, CASE WHEN n % 2 = 1 THEN a_id ELSE b_id END AS second_id FROM (SELECT *, row_number() OVER (ORDER BY sha256('42|' || pair_id), pair_id) - 1 AS n FROM pairs WHERE a_id IS NOT NULL AND b_id IS NOT NULL)")
def l08(spark, folder):
    """Every second pair in hash order with its sides exchanged."""
    t = table(spark, folder, "pairs").filter("a_id is not null and b_id is not null").withColumn("h", hash_order(F.lit("42"), F.col("pair_id")))
    swap = (F.col("n") - 1) % 2 == 1
    return ranks.global_row_number(t, [F.col("h"), F.col("pair_id")], "n").select("pair_id", F.when(swap, F.col("b_id")).otherwise(F.col("a_id")).alias("first_id"), F.when(swap, F.col("a_id")).otherwise(F.col("b_id")).alias("second_id"))


# ---- similarity ----

_TFIDF_SQL = f"""d AS (SELECT paper_id AS id, {_TERMS.format("title")} AS t FROM proreview),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)),
    v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""


def title_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.tfidf(table(spark, folder, "proreview").filter("title is not null").select(F.col("paper_id").alias("id"), text.terms(F.col("title")).alias("terms")))


@_query("v01_tfidf", f"WITH {_TFIDF_SQL} SELECT id, term, round(weight, 6) AS weight FROM v")
def v01(spark, folder):
    """Weighted terms of titles."""
    return _rounded(title_vectors(spark, folder), "weight")


_COSINE_SQL = "c AS (SELECT q.id AS query, v.id AS id, sum(q.weight * v.weight) AS cosine FROM v q JOIN v USING (term) WHERE q.id::BIGINT % 20 = 0 AND q.id <> v.id GROUP BY 1, 2)"


@_query("v02_cosine_search", f"WITH {_TFIDF_SQL}, {_COSINE_SQL} SELECT query, id, round(cosine, 6) AS cosine FROM c WHERE round(cosine, 9) >= 0.4")
def v02(spark, folder):
    """All papers whose titles are at least 0.4 alike to a query's; the queries are the ids divisible by 20."""
    v = title_vectors(spark, folder)
    q = v.filter(F.col("id").cast("bigint") % 20 == 0)
    return _rounded(similarity.cosines(q, v).filter(F.round("cosine", 9) >= 0.4), "cosine")


@_query(
    "j22_best_match",
    f"""WITH {_TFIDF_SQL}, {_COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, id) AS n, lead(round(cosine, 9), 1, 0) OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, id) AS second FROM c)
        SELECT query, id, round(cosine, 6) AS cosine FROM r WHERE n = 1 AND round(cosine, 9) >= 0.3 AND round(cosine, 9) - second >= 0.02""",
)
def j22(spark, folder):
    """The best match of each query if it leads clearly."""
    v = title_vectors(spark, folder)
    c = similarity.cosines(v.filter(F.col("id").cast("bigint") % 20 == 0), v).withColumn("cosine", F.round("cosine", 9))
    return _rounded(similarity.best_match(c, "query", "id", "cosine", 0.3, 0.02).select("query", "id", "cosine"), "cosine")


# ---- ranks and metrics ----


@_query("w01_average_ranks", f"SELECT paper_id, rank() OVER (ORDER BY rating) - 1 + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS rank FROM {PAPERS_SQL} WHERE rating IS NOT NULL")
def w01(spark, folder):
    """Ranks of ratings from 0, ties at their mean."""
    return ranks.average_ranks(papers(spark, folder).filter("rating is not null").select("paper_id", "rating"), "rating").select("paper_id", "rank")


_CUM = f"k AS (SELECT rating, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM {PAPERS_SQL} WHERE label IS NOT NULL AND rating IS NOT NULL GROUP BY 1)"


@_query("w03_cumulative", f"WITH {_CUM} SELECT round(rating, 6) AS score, sum(pos) OVER (ORDER BY rating DESC) AS true_positives, sum(pos + neg) OVER (ORDER BY rating DESC) AS predicted FROM k")
def w03(spark, folder):
    """True positives and predictions at each score as a threshold."""
    t = metrics._classes(papers(spark, folder), "label", "rating", descending=True)
    return t.select(F.round("score", 6).alias("score"), (F.col("pos_before") + F.col("pos")).alias("true_positives"), (F.col("pos_before") + F.col("neg_before") + F.col("pos") + F.col("neg")).alias("predicted"))


@_query("m01_auc", f"WITH {_CUM}, b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY rating ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos) AS positives, sum(neg) AS negatives FROM b")
def m01(spark, folder):
    return _rounded(metrics.auc(papers(spark, folder), "label", "rating"), "auc")


@_query("m06_average_precision", f"WITH {_CUM}, b AS (SELECT *, sum(pos) OVER (ORDER BY rating DESC) AS tp, sum(pos + neg) OVER (ORDER BY rating DESC) AS predicted FROM k) SELECT round(sum(pos * tp / predicted) / sum(pos), 6) AS average_precision FROM b")
def m06(spark, folder):
    return _rounded(metrics.average_precision(papers(spark, folder), "label", "rating"), "average_precision")


@_query(
    "m05_threshold_sweep",
    f"""WITH {_CUM}, s AS (SELECT sum(pos) AS p, sum(neg) AS n FROM k), b AS (SELECT rating AS threshold, sum(pos) OVER (ORDER BY rating DESC) AS tp, sum(neg) OVER (ORDER BY rating DESC) AS fp FROM k UNION ALL SELECT 'infinity'::DOUBLE, 0, 0),
        r AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / p AS recall, 2 * tp / (tp + fp + p) AS f1, (tp + n - fp) / (p + n) AS accuracy FROM b, s)
        SELECT 'f1' AS goal, * FROM (SELECT * FROM r ORDER BY round(f1, 12) DESC, threshold DESC LIMIT 1) UNION ALL SELECT 'accuracy', * FROM (SELECT * FROM r ORDER BY round(accuracy, 12) DESC, threshold DESC LIMIT 1)""",
)
def m05(spark, folder):
    return metrics.threshold_sweep(papers(spark, folder), "label", "rating")


_P = "1 / (1 + exp(-mock))"


def _probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).select("paper_id", "label", (1 / (1 + F.exp(-F.col("mock")))).alias("p"))


@_query("m07_probabilities", f"SELECT round(avg((p - label) ** 2), 6) AS brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss, round(avg(((p >= 0.5) = (label = 1))::INTEGER), 6) AS accuracy, count(*) AS n FROM (SELECT label, {_P} AS p FROM {PAPERS_SQL} WHERE label IS NOT NULL)")
def m07(spark, folder):
    return _rounded(metrics.probability_metrics(_probabilities(spark, folder), "label", "p"), "brier", "log_loss", "accuracy")


_BINS = f"(SELECT CAST(least(floor(round(p * 10, 9)), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS positives_share FROM (SELECT label, {_P} AS p FROM {PAPERS_SQL} WHERE label IS NOT NULL) GROUP BY 1)"


@_query("m08_calibration_bins", f"SELECT bin, n, round(mean_p, 6) AS mean_p, round(positives_share, 6) AS positives_share FROM {_BINS}")
def m08(spark, folder):
    return _rounded(metrics.calibration_bins(_probabilities(spark, folder), "label", "p"), "mean_p", "positives_share")


@_query("m08_ece", f"SELECT round(sum(n * abs(mean_p - positives_share)) / sum(n), 6) AS ece FROM {_BINS}")
def m08_ece(spark, folder):
    return _rounded(metrics.expected_calibration_error(_probabilities(spark, folder), "label", "p"), "ece")


_RANKED = f"(SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS rx, rank() OVER (ORDER BY mock) + (count(*) OVER (PARTITION BY mock) - 1) / 2 AS ry, rating, mock FROM {PAPERS_SQL} WHERE rating IS NOT NULL)"


@_query("m02_spearman", f"SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM {_RANKED}")
def m02(spark, folder):
    return _rounded(metrics.spearman(papers(spark, folder), "rating", "mock"), "spearman")


@_query("m03_pearson", f"SELECT round(corr(rating, mock), 6) AS pearson, count(*) AS n FROM {_RANKED}")
def m03(spark, folder):
    return _rounded(metrics.pearson(papers(spark, folder), "rating", "mock"), "pearson")


@_query(
    "m04_ndcg",
    f"""WITH k AS (SELECT rating AS g, CAST(floor(mock * 4) AS DOUBLE) AS s FROM {PAPERS_SQL} WHERE rating IS NOT NULL),
        a AS (SELECT avg(g) OVER (PARTITION BY s) AS g, row_number() OVER (ORDER BY s DESC) AS i FROM k), b AS (SELECT g, row_number() OVER (ORDER BY g DESC) AS i FROM k)
        SELECT round((SELECT sum(g / log2(i + 1)) FROM a WHERE i <= 20) / (SELECT sum(g / log2(i + 1)) FROM b WHERE i <= 20), 6) AS ndcg""",
)
def m04(spark, folder):
    """NDCG at 20 of coarse scores with many ties."""
    p = papers(spark, folder).select("rating", F.floor(F.col("mock") * 4).cast("double").alias("s"))
    return _rounded(metrics.ndcg(p, "rating", "s", 20), "ndcg")


@_query(
    "m12_concordance",
    f"""WITH k AS (SELECT venue, label, mock FROM {PAPERS_SQL} WHERE label IS NOT NULL)
        SELECT x.venue AS venue, count(*) AS pairs, count_if(x.mock < y.mock) AS "right", count_if(x.mock > y.mock) AS wrong, count_if(x.mock = y.mock) AS ties FROM k x JOIN k y ON x.venue IS NOT DISTINCT FROM y.venue AND x.label < y.label GROUP BY 1""",
)
def m12(spark, folder):
    """Per venue the pairs of an accepted and a rejected paper that the mock scores order rightly."""
    return metrics.concordance(papers(spark, folder), ["venue"], "label", "mock")


@_query("m28_percentiles", "SELECT n_name AS nation, round(quantile_cont(s_acctbal, 0.5), 4) AS linear, quantile_disc(s_acctbal, 0.5) AS nearest, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def m28(spark, folder):
    """The median by interpolation and by nearest rank."""
    t = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.groupBy(F.col("n_name").alias("nation")).agg(F.round(F.percentile("s_acctbal", F.lit(0.5)), 4).alias("linear"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s_acctbal)").alias("nearest"), F.count("*").alias("n"))


@_query("m29_benchmark", f"SELECT x.paper_id AS paper_id, CASE WHEN b.n IS NULL THEN 'insufficient' WHEN x.mock - b.p50 >= 0.5 THEN 'above' WHEN x.mock - b.p50 >= -0.5 THEN 'near' ELSE 'below' END AS verdict FROM {PAPERS_SQL} x LEFT JOIN (SELECT venue, quantile_cont(mock, 0.5) AS p50, count(*) AS n FROM {PAPERS_SQL} WHERE label = 1 GROUP BY 1) b ON b.venue = x.venue")
def m29(spark, folder):
    """Each paper against the median of its venue's accepted papers."""
    p = papers(spark, folder).select("paper_id", "venue", "label", "mock")
    b = p.filter("label = 1").groupBy("venue").agg(F.percentile("mock", F.lit(0.5)).alias("p50"))
    d = F.col("mock") - F.col("p50")
    return p.join(b, "venue", "left").select("paper_id", F.when(F.col("p50").isNull(), "insufficient").when(d >= 0.5, "above").when(d >= -0.5, "near").otherwise("below").alias("verdict"))


@_query("m21_bootstrap")
def m21(spark, folder):
    """How much more often judges agree with the ratings than the mock scores do, with a paired bootstrap interval."""
    t = pair_outcomes(spark, folder).join(verdicts(spark, folder).filter("said is not null"), "pair_id")
    judge = F.when(F.col("said") == "tie", 0.5).when(F.col("said") == F.when(F.col("delta") > 0, "A").otherwise("B"), 1.0).otherwise(0.0)
    mock = F.when(F.col("outcome") == "tie", 0.5).when(F.col("outcome") == "correct", 1.0).otherwise(0.0)
    return _rounded(metrics.paired_bootstrap(t.select(judge.alias("judge"), mock.alias("mock")), "judge", "mock", 5000), "difference", "low", "high")


# ---- rank aggregation ----

_BATCHED = "(SELECT b, s_suppkey AS item, row_number() OVER (PARTITION BY b ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r1, row_number() OVER (PARTITION BY b ORDER BY s_name DESC) - 1 AS r2 FROM (SELECT *, CAST(floor((s_suppkey - 1) / 4) AS BIGINT) AS b FROM supplier))"


def _rankings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, folder, "supplier").withColumn("batch", F.floor((F.col("s_suppkey") - 1) / 4)).withColumn("item", F.col("s_suppkey"))
    w = Window.partitionBy("batch")
    one = t.select("batch", "item", (F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")) - 1).alias("rank"))
    two = t.select("batch", "item", (F.row_number().over(w.orderBy(F.desc("s_name"))) - 1).alias("rank"))
    return one, two


@_query("r01_borda", f"SELECT b AS batch, item, r1 + r2 AS rank_sum FROM {_BATCHED}")
def r01(spark, folder):
    """Rank sums of two orders of the same batches."""
    one, two = _rankings(spark, folder)
    return fusion.borda(one, two, "batch", "item", "rank")


@_query("m19_order_agreement", f"SELECT count(*) AS pairs, count_if(sign(x.r1 - y.r1) = sign(x.r2 - y.r2)) AS same, round(avg((sign(x.r1 - y.r1) = sign(x.r2 - y.r2))::INTEGER), 6) AS share FROM {_BATCHED} x JOIN {_BATCHED} y ON x.b = y.b AND x.item < y.item")
def m19(spark, folder):
    """How far two runs order the batches alike."""
    one, two = _rankings(spark, folder)
    return _rounded(fusion.order_agreement(one, two, "batch", "item", "rank"), "share")


@_query("m20_position_bias", f"SELECT count(*) AS pairs, count_if(sign(x.r1 - y.r1) = sign(x.item - y.item)) AS same, round(avg((sign(x.r1 - y.r1) = sign(x.item - y.item))::INTEGER), 6) AS share FROM {_BATCHED} x JOIN {_BATCHED} y ON x.b = y.b AND x.item < y.item")
def m20(spark, folder):
    """How far the order that comes out of a batch follows the order that went in."""
    one, _ = _rankings(spark, folder)
    given = one.select("batch", "item", F.col("item").alias("rank"))
    return _rounded(fusion.order_agreement(one, given, "batch", "item", "rank"), "share")


@_query("u09_tagged_union", f"SELECT b AS batch, item, r1 AS rank, 'original' AS orientation FROM {_BATCHED} UNION ALL SELECT b, item, r2, 'reversed' FROM {_BATCHED}")
def u09(spark, folder):
    """Two runs as one relation with their name."""
    one, two = _rankings(spark, folder)
    return one.withColumn("orientation", F.lit("original")).unionByName(two.withColumn("orientation", F.lit("reversed")))


@_query("j24_positional_zip", "SELECT item_id, doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM heldout_items) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) USING (n)")
def j24(spark, folder):
    """Two tables row by row in the order of their keys."""
    a = ranks.global_row_number(table(spark, folder, "heldout_items").select("item_id"), [F.col("item_id")], "n")
    b = ranks.global_row_number(table(spark, folder, "documents").select("doc_id"), [F.col("doc_id")], "n")
    return a.join(b, "n").select("item_id", "doc_id")


# ---- calibration ----


@_query(
    "c06_mid_rank_percentile",
    f"""WITH r AS (SELECT mock FROM {PAPERS_SQL} WHERE year <= 2024), q AS (SELECT paper_id, mock FROM {PAPERS_SQL} WHERE year > 2024)
        SELECT paper_id, round(greatest(0, least(100, 100 * ((SELECT count(*) FROM r WHERE r.mock < q.mock) + (SELECT count(*) FROM r WHERE r.mock <= q.mock) - 1) / 2 / ((SELECT count(*) FROM r) - 1))), 1) AS percentile FROM q""",
)
def c06(spark, folder):
    """Where the later papers' scores lie among the earlier ones'."""
    p = papers(spark, folder).select("paper_id", "year", "mock")
    return calibration.mid_rank_percentile(p.filter("year > 2024").select("paper_id", "mock"), "mock", p.filter("year <= 2024").select(F.col("mock").alias("ref")), "ref").select("paper_id", "percentile")


@_query("c02_standardised", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size FROM part")
def c02(spark, folder):
    t = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return _rounded(calibration.standardised(t, ["p_size"], calibration.column_scales(t, ["p_size"])), "p_size")


@_query("c01_logistic")
def c01(spark, folder):
    """Acceptance from rating and number of reviews: standardised, fitted by distributed Newton steps, decided in three ways."""
    p = papers(spark, folder).filter("rating is not null").select("paper_id", "label", "rating", F.size("rs").cast("double").alias("reviews"))
    z = calibration.standardised(p, ["rating", "reviews"], calibration.column_scales(p, ["rating", "reviews"]))
    w, b = calibration.logistic_regression(z, ["rating", "reviews"], "label")
    s = calibration.linear(["rating", "reviews"], w, b)
    out = z.withColumn("p", 1 / (1 + F.exp(-s)))
    return out.select("paper_id", F.round("p", 5).alias("p"), calibration.decision(F.col("p")).alias("decision"))
