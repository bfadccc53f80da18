"""Queries of joins, aggregations, set operations, labels and guards over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.functions.hashing import mock_score
from folioflow.functions.numbers import bucket, ratio, wilson
from folioflow.operators import fusion, labels, metrics, validation
from folioflow.operators.ranks import evenly_spaced, global_row_number, group_row_number, tile
from folioflow.operators.sampling import band_diverse, stratified_quota, top_per_group
from folioflow.operators.scoring import close_json, parses, score
from folioflow.sources.tables import table
from folioflow.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# ---- bases that several queries share ----

LEVEL = r"(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?)"
_NUM = "CAST(nullif(regexp_extract({0}, '" + LEVEL + "', 1), '') AS DOUBLE)"
REVIEWS_SQL = f"""(SELECT review_id, paper_id, reviewer_id, {_NUM.format("rating")} AS rating, {_NUM.format("confidence")} AS confidence, created_at
    FROM review_scores WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY received_at DESC) = 1)"""
_LIST = "list_filter(list_transform(regexp_split_to_array({0}, '[;,|[:space:]]+'), lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL)"
PAPERS_SQL = f"""(SELECT paper_id, title, decision, venue, year, rs, cs, CASE
      WHEN len(rs) > 0 AND len(rs) = len(cs) AND list_sum(cs) > 0 THEN list_sum(list_transform(list_zip(rs, cs), lambda x: x[1] * x[2])) / list_sum(cs)
      WHEN len(rs) > 0 THEN list_sum(rs) / len(rs) ELSE stated END AS rating,
      CASE WHEN contains(lower(coalesce(decision, '')), 'withdraw') THEN NULL WHEN regexp_matches(lower(coalesce(decision, '')), 'reject|decline') THEN 0
           WHEN regexp_matches(lower(coalesce(decision, '')), '(^|[^a-z0-9_])accept($|[^a-z0-9_])|poster|spotlight|oral') THEN 1 END AS label,
      round(('0x' || substr(sha256(paper_id), 1, 8))::UBIGINT::DOUBLE / 4294967295 * 8 - 4, 6) AS mock
    FROM (SELECT paper_id, title, decision.decision AS decision, {_LIST.format("scores.rating")} AS rs, {_LIST.format("scores.confidence")} AS cs, scores.rating_avg AS stated,
          regexp_extract(lower(regexp_replace(metadata.venueid, '[[:space:]]+', '', 'g')), '^/*([^/]+)', 1) AS venue,
          CAST(nullif(regexp_extract(metadata.venueid, '(20[0-9][0-9])', 1), '') AS INTEGER) AS year FROM proreview))"""


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Each review's latest delivery with its scores as numbers."""
    t = table(spark, folder, "review_scores").filter("review_id is not null")
    kept = incremental.last_wins(t, ["review_id"], ["received_at"])
    number = lambda c: F.when(F.regexp_extract(c, LEVEL, 1) != "", F.regexp_extract(c, LEVEL, 1)).cast("double")
    return kept.select("review_id", "paper_id", "reviewer_id", number(F.col("rating")).alias("rating"), number(F.col("confidence")).alias("confidence"), "created_at")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Each paper with its rating, its label and a mock score."""
    t = table(spark, folder, "proreview")
    rs, cs = text.number_list(F.col("scores.rating")), text.number_list(F.col("scores.confidence"))
    venue = F.regexp_extract(F.lower(F.regexp_replace("metadata.venueid", r"\s+", "")), "^/*([^/]+)", 1)
    year = F.regexp_extract("metadata.venueid", "(20[0-9][0-9])", 1)
    return t.select(
        "paper_id",
        "title",
        F.col("decision.decision").alias("decision"),
        venue.alias("venue"),
        F.when(year != "", year).cast("int").alias("year"),
        rs.alias("rs"),
        cs.alias("cs"),
        labels.weighted_rating(rs, cs, F.col("scores.rating_avg")).alias("rating"),
        text.decision_label(F.col("decision.decision"), "strict").alias("label"),
        mock_score(F.col("paper_id")).alias("mock"),
    )


# ---- aggregations ----


@_query("a01_distribution", "SELECT CAST(doc_kind AS VARCHAR) AS value, count(*) AS n FROM documents GROUP BY 1")
def a01(spark, folder):
    """Rows per value."""
    return table(spark, folder, "documents").groupBy(F.col("doc_kind").cast("string").alias("value")).agg(F.count("*").alias("n"))


_FLAGS_SQL = """(SELECT case_id, list_filter([CASE WHEN manuscript.title IS NULL OR trim(manuscript.title) = '' THEN 'no_title' END, CASE WHEN manuscript.paragraphs IS NULL OR len(manuscript.paragraphs) = 0 THEN 'no_text' END,
    CASE WHEN gold IS NULL OR gold.issues IS NULL THEN 'no_gold' END, CASE WHEN source.forum_id IS NULL THEN 'no_forum' END, CASE WHEN source.venue_id IS NULL THEN 'no_venue' END,
    CASE WHEN human_references IS NULL OR len(human_references) = 0 THEN 'no_reference' END], lambda x: x IS NOT NULL) AS flags FROM cases)"""


def quality_flags(spark, folder):
    """The conditional flags of each record, as an array without nulls."""
    t = table(spark, folder, "cases")
    size = lambda c: F.coalesce(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    title = F.col("manuscript.title")
    flags = {"no_title": title.isNull() | (F.trim(title) == ""), "no_text": size("manuscript.paragraphs") == 0, "no_gold": F.col("gold.issues").isNull(), "no_forum": F.col("source.forum_id").isNull(), "no_venue": F.col("source.venue_id").isNull(), "no_reference": size("human_references") == 0}
    return t.select("case_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])).alias("flags"))


QUERIES["p09_quality_flags"] = quality_flags
ORACLE["p09_quality_flags"] = f"SELECT case_id, flags FROM {_FLAGS_SQL}"


@_query("a03_flag_histogram", f"SELECT flag, count(*) AS records FROM (SELECT unnest(list_distinct(flags)) AS flag FROM {_FLAGS_SQL}) GROUP BY 1")
def a03(spark, folder):
    """How many records carry each flag."""
    return quality_flags(spark, folder).select(F.explode(F.array_distinct("flags")).alias("flag")).groupBy("flag").agg(F.count("*").alias("records"))


@_query("a04_zero_filled", "SELECT k.kind AS kind, count(d.doc_id) AS n FROM (SELECT unnest(['review', 'meta_review', 'decision_note', 'author_response', 'comment']) AS kind) k LEFT JOIN documents d ON d.doc_kind = k.kind GROUP BY 1")
def a04(spark, folder):
    """Counts over a fixed domain, zero where nothing is there."""
    domain = spark.createDataFrame([(k,) for k in ("review", "meta_review", "decision_note", "author_response", "comment")], "kind string")
    n = table(spark, folder, "documents").groupBy(F.col("doc_kind").alias("kind")).agg(F.count("*").alias("n"))
    return domain.join(n, "kind", "left").na.fill(0, ["n"])


_OK = "count_if(status = 'ok')"


@_query(
    "a05_conditional_ratios",
    f"SELECT model, count(*) AS runs, round({_OK} / count(*), 6) AS ok_share, round(CASE WHEN {_OK} > 0 THEN count_if(status = 'ok' AND schema_valid) / {_OK} END, 6) AS valid_share, round(avg(latency_ms), 4) AS mean_latency FROM eval_runs GROUP BY 1",
)
def a05(spark, folder):
    """Shares with a stated denominator, null where it is zero."""
    ok = F.count_if(F.col("status") == "ok")
    return table(spark, folder, "eval_runs").groupBy("model").agg(F.count("*").alias("runs"), F.round(ok / F.count("*"), 6).alias("ok_share"), F.round(ratio(F.count_if((F.col("status") == "ok") & F.col("schema_valid")), ok), 6).alias("valid_share"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"))


@_query("a06_pivot", f"SELECT year, count_if(label = 0) AS n_0, count_if(label = 1) AS n_1, count_if(label IS NULL) AS n_unknown FROM {PAPERS_SQL} GROUP BY 1")
def a06(spark, folder):
    """Counts by year and label, zero-filled."""
    p = papers(spark, folder).select("year", F.coalesce(F.col("label").cast("string"), F.lit("unknown")).alias("label"))
    out = p.groupBy("year").pivot("label", ["0", "1", "unknown"]).count().na.fill(0, ["0", "1", "unknown"])
    return out.withColumnsRenamed({"0": "n_0", "1": "n_1", "unknown": "n_unknown"})


_STATS = "count({0}) AS n, min({0}) AS least, max({0}) AS most, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS deviation, count(DISTINCT {0}) AS distinct_values, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.95), 6) AS p95"


def _stats(c: str):
    return [F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("deviation"), F.count_distinct(c).alias("distinct_values"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("p95")]


@_query("a07_statistics", f"SELECT reviewer_id, {_STATS.format('rating')} FROM {REVIEWS_SQL} GROUP BY 1")
def a07(spark, folder):
    """Count, ends, mean, population deviation, distinct values and exact quantiles per group."""
    return reviews(spark, folder).groupBy("reviewer_id").agg(*_stats("rating"))


@_query("a08_frame_statistics", f"SELECT doc_kind, {_STATS.format('length(text)')}, count(DISTINCT (venue_id, lang)) AS clusters FROM documents GROUP BY 1")
def a08(spark, folder):
    """Text lengths per kind of document, and distinct pairs of venue and language."""
    t = table(spark, folder, "documents").withColumn("size", F.length("text"))
    return t.groupBy("doc_kind").agg(*_stats("size"), F.size(F.collect_set(F.struct(F.coalesce("venue_id", F.lit("\0")), F.coalesce("lang", F.lit("\0"))))).cast("bigint").alias("clusters"))


@_query(
    "a09_usage_by_request",
    """SELECT model, count(*) AS requests, sum(coalesce(usage_batch.promptTokens, 0)) AS prompt_tokens, sum(coalesce(usage_batch.completionTokens, 0)) AS completion_tokens
       FROM (SELECT * FROM pairwise_results WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, pair_id DESC) = 1) GROUP BY 1""",
)
def a09(spark, folder):
    """Totals that count each request once, by its last row."""
    t = table(spark, folder, "pairwise_results").filter("request_id is not null").select("request_id", "received_at", "pair_id", "model", "usage_batch")
    one = incremental.last_wins(t, ["request_id"], ["received_at", "pair_id"])
    n = lambda f: F.sum(F.coalesce(F.col(f"usage_batch.{f}"), F.lit(0)))
    return one.groupBy("model").agg(F.count("*").alias("requests"), n("promptTokens").alias("prompt_tokens"), n("completionTokens").alias("completion_tokens"))


@_query("a10_runtime", "SELECT model, sum(latency_ms) AS total, round(avg(latency_ms), 4) AS mean, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, min(latency_ms) AS least, max(latency_ms) AS most, sum(usage.output_tokens) AS tokens FROM eval_runs GROUP BY 1")
def a10(spark, folder):
    """Latency and tokens per model."""
    return table(spark, folder, "eval_runs").groupBy("model").agg(F.sum("latency_ms").alias("total"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.round(F.percentile("latency_ms", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"), F.sum("usage.output_tokens").alias("tokens"))


_HITS = "(SELECT user_id AS item, event_type AS query, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank, value AS relevance FROM events)"


@_query("a11_rank_fusion", f"SELECT item, count(*) AS hits, count(DISTINCT query) AS queries, round(sum(1 / (rank + 1.0)), 6) AS rrf, max(relevance) AS relevance FROM {_HITS} GROUP BY 1")
def a11(spark, folder):
    """Reciprocal-rank fusion of what each kind of event ranks by its value."""
    t = group_row_number(table(spark, folder, "events").select("event_id", "event_type", "user_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")])
    hits = t.select(F.col("user_id").alias("item"), F.col("event_type").alias("query"), (F.col("row_number") - 1).alias("rank"), F.col("value").alias("relevance"))
    return fusion.reciprocal_rank_fusion(hits, "item", "query", "rank", "relevance").withColumn("rrf", F.round("rrf", 6))


@_query(
    "a12_precision_weighted",
    f"""WITH r AS (SELECT * FROM {REVIEWS_SQL} WHERE rating IS NOT NULL AND confidence IS NOT NULL AND paper_id IS NOT NULL),
        e AS (SELECT min(rating) r0, max(rating) r1, min(confidence) c0, max(confidence) c1 FROM r),
        s AS (SELECT paper_id, (rating - r0) / (r1 - r0) AS s, 1 / (0.2 * (1 - (0.2 + 0.8 * (confidence - c0) / (c1 - c0))) + 0.05) ** 2 AS w FROM r, e)
        SELECT paper_id, round(sum(s * w) / sum(w), 6) AS label, count(*) AS n FROM s GROUP BY 1""",
)
def a12(spark, folder):
    """Precision-weighted ratings after global scaling."""
    return labels.precision_weighted(reviews(spark, folder), "paper_id", "rating", "confidence").withColumn("label", F.round("label", 6))


@_query("a13_weighted_rating", f"SELECT paper_id, round(rating, 6) AS rating FROM {PAPERS_SQL}")
def a13(spark, folder):
    """Confidence-weighted ratings with their fallbacks."""
    return papers(spark, folder).select("paper_id", F.round("rating", 6).alias("rating"))


@_query("a14_nested_ends", "SELECT min(r.initial_rating) AS r0, max(r.initial_rating) AS r1, min(r.confidence) AS c0, max(r.confidence) AS c1, count(*) AS n FROM (SELECT unnest(reviews) AS r FROM proreview)")
def a14(spark, folder):
    """The ends of nested scores over the whole table."""
    r = table(spark, folder, "proreview").select(F.explode("reviews").alias("r"))
    return r.agg(F.min("r.initial_rating").alias("r0"), F.max("r.initial_rating").alias("r1"), F.min("r.confidence").alias("c0"), F.max("r.confidence").alias("c1"), F.count("*").alias("n"))


_TERMS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], w))"


@_query("a15_document_frequency", f"SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct({_TERMS.format('title')})) AS term FROM proreview) GROUP BY 1")
def a15(spark, folder):
    """In how many titles each term occurs."""
    return table(spark, folder, "proreview").select(F.explode(F.array_distinct(text.terms(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


_PAIRS_SQL = f"""(SELECT p.pair_id, x.venue AS venue, x.year AS year, x.rating - y.rating AS delta, x.mock - y.mock AS guess,
    CASE WHEN abs(x.mock - y.mock) <= 0.2 THEN 'tie' WHEN sign(x.mock - y.mock) = sign(x.rating - y.rating) THEN 'correct' ELSE 'incorrect' END AS outcome
    FROM pairs p JOIN {PAPERS_SQL} x ON x.paper_id = p.a_id JOIN {PAPERS_SQL} y ON y.paper_id = p.b_id WHERE x.rating <> y.rating)"""
_METRICS = """count(*) AS pairs, count_if(outcome = 'tie') AS ties, round(count_if(outcome = 'tie') / count(*), 6) AS tie_share,
    round(CASE WHEN count_if(outcome <> 'tie') > 0 THEN count_if(outcome = 'correct') / count_if(outcome <> 'tie') END, 6) AS accuracy, round((count_if(outcome = 'correct') + count_if(outcome = 'tie') / 2) / count(*), 6) AS tie_half_accuracy"""


def pair_outcomes(spark, folder):
    """The pairs of two papers with different ratings, and what the mock scores make of each."""
    p = papers(spark, folder).select("paper_id", "venue", "year", "rating", "mock")
    a, b = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns]), p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    t = table(spark, folder, "pairs").join(a, F.col("a_id") == F.col("a_paper_id")).join(b, F.col("b_id") == F.col("b_paper_id")).filter("a_rating <> b_rating")
    delta, guess = F.col("a_rating") - F.col("b_rating"), F.col("a_mock") - F.col("b_mock")
    return t.select("pair_id", F.col("a_venue").alias("venue"), F.col("a_year").alias("year"), delta.alias("delta"), guess.alias("guess"), metrics.pair_outcomes(guess, delta, 0.2).alias("outcome"))


def _pair_metrics():
    n, tie, right = F.count("*"), F.count_if(F.col("outcome") == "tie"), F.count_if(F.col("outcome") == "correct")
    decided = F.count_if(F.col("outcome") != "tie")
    return [n.alias("pairs"), tie.alias("ties"), F.round(tie / n, 6).alias("tie_share"), F.round(ratio(right, decided), 6).alias("accuracy"), F.round((right + tie / 2) / n, 6).alias("tie_half_accuracy")]


@_query("a16_grouping_sets", f"SELECT venue, year, {_METRICS} FROM {_PAIRS_SQL} GROUP BY GROUPING SETS ((), (venue), (year))")
def a16(spark, folder):
    """The metrics of pairs for all, per venue and per year, in one aggregation."""
    t = pair_outcomes(spark, folder)
    return t.groupingSets([[], [F.col("venue")], [F.col("year")]], F.col("venue"), F.col("year")).agg(*_pair_metrics())


@_query("m13_pair_outcomes", f"SELECT pair_id, round(delta, 6) AS delta, round(guess, 6) AS guess, outcome FROM {_PAIRS_SQL}")
def m13(spark, folder):
    return pair_outcomes(spark, folder).select("pair_id", F.round("delta", 6).alias("delta"), F.round("guess", 6).alias("guess"), "outcome")


_W = "s / n::DOUBLE + 1.959964 ** 2 / (2 * n)"
_WS = "1.959964 * sqrt(s / n::DOUBLE * (1 - s / n::DOUBLE) / n + 1.959964 ** 2 / (4 * n * n))"


@_query(
    "f52_wilson",
    f"SELECT venue, s, n, round(greatest(0, ({_W} - {_WS}) / (1 + 1.959964 ** 2 / n)), 6) AS low, round(least(1, ({_W} + {_WS}) / (1 + 1.959964 ** 2 / n)), 6) AS high FROM (SELECT venue, count_if(outcome = 'correct') AS s, count_if(outcome <> 'tie') AS n FROM {_PAIRS_SQL} GROUP BY 1) WHERE n > 0",
)
def f52(spark, folder):
    """Score intervals of the accuracy per venue."""
    t = pair_outcomes(spark, folder).groupBy("venue").agg(F.count_if(F.col("outcome") == "correct").alias("s"), F.count_if(F.col("outcome") != "tie").alias("n")).filter("n > 0")
    low, high = wilson(F.col("s"), F.col("n"))
    return t.select("venue", "s", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_VERDICT = "CASE WHEN regexp_matches(lower(regexp_replace({0}, '[[:space:]]+', '', 'g')), '^(paper|candidate)?_?a[.]?$') THEN 'A' WHEN regexp_matches(lower(regexp_replace({0}, '[[:space:]]+', '', 'g')), '^(paper|candidate)?_?b[.]?$') THEN 'B' WHEN regexp_matches(lower(regexp_replace({0}, '[[:space:]]+', '', 'g')), '^(tie|draw|a=b)$') THEN 'tie' END"
_SAID_SQL = f"(SELECT pair_id, model, confidence, {_VERDICT.format('winner')} AS said FROM pairwise_results WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY received_at DESC) = 1)"


def verdicts(spark, folder):
    """Each pair's latest verdict as A, B, tie or null."""
    t = incremental.last_wins(table(spark, folder, "pairwise_results").filter("pair_id is not null"), ["pair_id"], ["received_at"])
    s = F.lower(F.regexp_replace("winner", r"\s+", ""))
    said = F.when(s.rlike("^(paper|candidate)?_?a[.]?$"), "A").when(s.rlike("^(paper|candidate)?_?b[.]?$"), "B").when(s.rlike("^(tie|draw|a=b)$"), "tie")
    return t.select("pair_id", "model", "confidence", said.alias("said"))


@_query(
    "a17_discordance",
    f"""SELECT count_if(a AND b) AS both, count_if(a AND NOT b) AS first_only, count_if(b AND NOT a) AS second_only, count_if(NOT a AND NOT b) AS neither, round(avg((a = b)::INTEGER), 6) AS agreement
        FROM (SELECT v.said = CASE WHEN o.delta > 0 THEN 'A' ELSE 'B' END AS a, o.outcome = 'correct' AS b FROM {_PAIRS_SQL} o JOIN {_SAID_SQL} v USING (pair_id) WHERE v.said IS NOT NULL)""",
)
def a17(spark, folder):
    """The 2 x 2 table of two judges against the ratings."""
    t = pair_outcomes(spark, folder).join(verdicts(spark, folder).filter("said is not null"), "pair_id")
    t = t.select((F.col("said") == F.when(F.col("delta") > 0, "A").otherwise("B")).alias("a"), (F.col("outcome") == "correct").alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"), F.count_if(~a & ~b).alias("neither"), F.round(F.avg((a == b).cast("int")), 6).alias("agreement"))


@_query("a18_scales", "SELECT round(avg(l_quantity), 6) AS mean_quantity, round(CASE WHEN var_pop(l_quantity) <= 1e-12 THEN 1 ELSE sqrt(var_pop(l_quantity)) END, 6) AS scale_quantity, round(avg(l_discount), 6) AS mean_discount, round(CASE WHEN var_pop(l_discount) <= 1e-12 THEN 1 ELSE sqrt(var_pop(l_discount)) END, 6) AS scale_discount FROM lineitem")
def a18(spark, folder):
    """Means and population deviations, 1 where there is no spread."""
    scale = lambda c: F.round(F.when(F.var_pop(c) <= 1e-12, 1.0).otherwise(F.sqrt(F.var_pop(c))), 6)
    return table(spark, folder, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), scale("l_quantity").alias("scale_quantity"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), scale("l_discount").alias("scale_discount"))


@_query("a19_support", "SELECT lower(trim(coalesce(nullif(source.venue_id, ''), source.dataset, 'unknown'))) AS venue_key, count(*) AS n, count(DISTINCT case_id) AS cases FROM cases GROUP BY 1")
def a19(spark, folder):
    """Rows per key with its fallbacks."""
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col("source.venue_id"), F.lit("")), F.col("source.dataset"), F.lit("unknown"))))
    return table(spark, folder, "cases").groupBy(key.alias("venue_key")).agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


@_query(
    "a20_macro_micro",
    """WITH l AS (SELECT case_id, unnest(i.evidence_paragraph_ids) AS e FROM (SELECT case_id, unnest(gold.issues) AS i FROM cases)), p AS (SELECT DISTINCT case_id, x.paragraph_id AS e FROM (SELECT case_id, unnest(manuscript.paragraphs) AS x FROM cases)),
       g AS (SELECT l.case_id, count(*) AS checked, count(p.e) AS grounded FROM l LEFT JOIN p ON p.case_id = l.case_id AND p.e = l.e WHERE l.e IS NOT NULL GROUP BY 1)
       SELECT round(avg(grounded / checked), 6) AS macro, round(sum(grounded) / sum(checked), 6) AS micro, sum(checked) AS checked FROM g""",
)
def a20(spark, folder):
    """The mean of shares per case, and the share of the totals."""
    t = table(spark, folder, "cases")
    links = t.select("case_id", F.explode("gold.issues.evidence_paragraph_ids").alias("l")).select("case_id", F.explode("l").alias("e")).filter("e is not null")
    there = t.select("case_id", F.explode("manuscript.paragraphs.paragraph_id").alias("e")).distinct().withColumn("there", F.lit(1))
    g = links.join(there, ["case_id", "e"], "left").groupBy("case_id").agg(F.count("*").alias("checked"), F.count("there").alias("grounded"))
    return g.agg(F.round(F.avg(F.col("grounded") / F.col("checked")), 6).alias("macro"), F.round(F.sum("grounded") / F.sum("checked"), 6).alias("micro"), F.sum("checked").alias("checked"))


@_query("a22_progress", "SELECT source.dataset AS dataset, count(DISTINCT c.case_id) AS cases, count(DISTINCT r.case_id) AS done FROM cases c LEFT JOIN (SELECT DISTINCT case_id FROM eval_runs WHERE status = 'ok') r ON r.case_id = c.case_id GROUP BY 1")
def a22(spark, folder):
    """How many cases of each dataset have a run that is ok."""
    done = table(spark, folder, "eval_runs").filter("status = 'ok'").select("case_id").distinct().withColumn("done", F.lit(True))
    t = table(spark, folder, "cases").select("case_id", F.col("source.dataset").alias("dataset")).distinct().join(done, "case_id", "left")
    return t.groupBy("dataset").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct(F.when(F.col("done"), F.col("case_id"))).alias("done"))


@_query("a23_gap_histogram", "SELECT CAST(least(floor(abs(rts_gap) / 0.1), 9) AS INTEGER) AS bucket, count(*) AS pairs FROM pairs WHERE rts_gap IS NOT NULL GROUP BY 1")
def a23(spark, folder):
    """Pairs in ten half-open buckets of their gap."""
    return table(spark, folder, "pairs").filter("rts_gap is not null").groupBy(bucket(F.col("rts_gap"), 0.1, 10).alias("bucket")).agg(F.count("*").alias("pairs"))


@_query("a24_usage_histogram", "SELECT uses, count(*) AS papers FROM (SELECT paper_id, count(*) AS uses FROM (SELECT a_id AS paper_id FROM pairs UNION ALL SELECT b_id FROM pairs) WHERE paper_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def a24(spark, folder):
    """How many papers are used how often."""
    t = table(spark, folder, "pairs").select(F.explode(F.array("a_id", "b_id")).alias("paper_id")).filter("paper_id is not null")
    return t.groupBy("paper_id").agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("papers"))


@_query("a26_means_by_label", f"SELECT round(avg(label), 6) AS prior, round(avg(CASE WHEN label = 1 THEN rating END), 6) AS accepted, round(avg(CASE WHEN label = 0 THEN rating END), 6) AS rejected, count(label) AS n FROM {PAPERS_SQL}")
def a26(spark, folder):
    """The prior, and the mean rating of either class."""
    return papers(spark, folder).agg(F.round(F.avg("label"), 6).alias("prior"), F.round(F.avg(F.when(F.col("label") == 1, F.col("rating"))), 6).alias("accepted"), F.round(F.avg(F.when(F.col("label") == 0, F.col("rating"))), 6).alias("rejected"), F.count("label").alias("n"))


@_query("a28_nested_counts", "SELECT count(*) AS issues, count(DISTINCT case_id) AS cases, round(avg(len(i.evidence_paragraph_ids)), 6) AS mean_links FROM (SELECT case_id, unnest(gold.issues) AS i FROM cases)")
def a28(spark, folder):
    """Counts over two nested levels."""
    t = table(spark, folder, "cases").select("case_id", F.explode("gold.issues").alias("i"))
    links = F.when(F.col("i.evidence_paragraph_ids").isNotNull(), F.size("i.evidence_paragraph_ids"))
    return t.agg(F.count("*").alias("issues"), F.count_distinct("case_id").alias("cases"), F.round(F.avg(links), 6).alias("mean_links"))


@_query("a29_over_limit", "SELECT model, max(length(prompt)) AS longest, count_if(length(prompt) > 900) AS over_limit, round(quantile_cont(length(prompt), 0.95), 4) AS p95 FROM eval_runs GROUP BY 1")
def a29(spark, folder):
    """Input lengths against a limit."""
    n = F.length("prompt")
    return table(spark, folder, "eval_runs").groupBy("model").agg(F.max(n).alias("longest"), F.count_if(n > 900).alias("over_limit"), F.round(F.percentile(n, F.lit(0.95)), 4).alias("p95"))


@_query("a30_verdict_rates", f"SELECT model, count(*) AS n, round(avg(coalesce(confidence, 0)), 6) AS confidence, round(avg((coalesce(said, '') = 'A')::INTEGER), 6) AS a_rate, round(avg((coalesce(said, '') = 'B')::INTEGER), 6) AS b_rate, round(avg((coalesce(said, '') = 'tie')::INTEGER), 6) AS tie_rate FROM {_SAID_SQL} GROUP BY 1")
def a30(spark, folder):
    """Mean confidence (null as 0) and the rates of verdicts."""
    said = F.coalesce(F.col("said"), F.lit(""))
    rate = lambda x: F.round(F.avg((said == x).cast("int")), 6)
    return verdicts(spark, folder).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence"), rate("A").alias("a_rate"), rate("B").alias("b_rate"), rate("tie").alias("tie_rate"))


@_query("m16_orientation_audit", f"SELECT CASE WHEN o.delta > 0 THEN 'A' ELSE 'B' END AS side, count(*) AS pairs, round(count_if(v.said = CASE WHEN o.delta > 0 THEN 'A' ELSE 'B' END) / nullif(count_if(v.said <> 'tie'), 0), 6) AS accuracy FROM {_PAIRS_SQL} o JOIN {_SAID_SQL} v USING (pair_id) WHERE v.said IS NOT NULL GROUP BY 1")
def m16(spark, folder):
    """Accuracy without ties by the side that is better: a judge that favours a side shows here."""
    side = F.when(F.col("delta") > 0, "A").otherwise("B")
    t = pair_outcomes(spark, folder).join(verdicts(spark, folder).filter("said is not null"), "pair_id").withColumn("side", side)
    return t.groupBy("side").agg(F.count("*").alias("pairs"), F.round(ratio(F.count_if(F.col("said") == F.col("side")), F.count_if(F.col("said") != "tie")), 6).alias("accuracy"))


# ---- joins and sets ----


@_query("j01_last_wins_join", "SELECT c.case_id AS case_id, c.source.dataset AS dataset, r.run_id AS run_id, r.model AS model FROM (SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1) c JOIN (SELECT * FROM eval_runs WHERE status = 'ok' AND raw_output <> '' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY finished_at DESC, run_id DESC) = 1) r USING (case_id)")
def j01(spark, folder):
    """Cases with the last of their sound runs."""
    runs = incremental.last_wins(table(spark, folder, "eval_runs").filter("status = 'ok' and raw_output <> ''").select("case_id", "finished_at", "run_id", "model"), ["case_id"], ["finished_at", "run_id"])
    cases = incremental.last_wins(table(spark, folder, "cases").filter("case_id is not null").select("case_id", "received_at", F.col("source.dataset").alias("dataset")), ["case_id"], ["received_at"])
    return cases.join(runs, "case_id").select("case_id", "dataset", "run_id", "model")


@_query("j04_missing_lookup", "SELECT pair_id, a.paper_id IS NULL AS no_a, b.paper_id IS NULL AS no_b FROM pairs p LEFT JOIN (SELECT DISTINCT paper_id FROM proreview UNION SELECT paper_id FROM anchor_papers) a ON a.paper_id = a_id LEFT JOIN (SELECT DISTINCT paper_id FROM proreview UNION SELECT paper_id FROM anchor_papers) b ON b.paper_id = b_id WHERE a.paper_id IS NULL OR b.paper_id IS NULL")
def j04(spark, folder):
    """Pairs a side of which no table knows."""
    known = table(spark, folder, "proreview").select("paper_id").unionByName(table(spark, folder, "anchor_papers").select("paper_id")).distinct()
    t = table(spark, folder, "pairs").join(known.select(F.col("paper_id").alias("a_id"), F.lit(True).alias("a")), "a_id", "left").join(known.select(F.col("paper_id").alias("b_id"), F.lit(True).alias("b")), "b_id", "left")
    return t.filter("a is null or b is null").select("pair_id", F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"))


_TKEY = "array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '^ | $', '', 'g'), ' '), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.TITLE_WORDS) + "], w)), ' ')"
_SPLIT_TEST = "regexp_matches(lower(coalesce(source.split, '')), 'test')"


@_query(
    "j12_without_overlap",
    f"""WITH t AS (SELECT {_TKEY.format("manuscript.title")} AS k, source.forum_id AS f FROM cases WHERE {_SPLIT_TEST})
        SELECT DISTINCT case_id FROM cases WHERE regexp_matches(lower(coalesce(source.split, '')), 'train') AND (manuscript.title IS NULL OR {_TKEY.format("manuscript.title")} = '' OR {_TKEY.format("manuscript.title")} NOT IN (SELECT k FROM t WHERE k IS NOT NULL))
        AND (source.forum_id IS NULL OR source.forum_id NOT IN (SELECT f FROM t WHERE f IS NOT NULL))""",
)
def j12(spark, folder):
    """Training cases that share neither title key nor forum with a test case."""
    t = table(spark, folder, "cases").select("case_id", F.lower(F.coalesce("source.split", F.lit(""))).alias("split"), F.col("manuscript.title").alias("title"), F.col("source.forum_id").alias("forum"))
    train, test = t.filter("split like '%train%'"), t.filter("split like '%test%'")
    return validation.without_overlap(train, test, [text.title_key(F.col("title")), F.col("forum")]).select("case_id").distinct()


@_query("j14_pending", "SELECT DISTINCT case_id FROM cases WHERE case_id IS NOT NULL AND case_id NOT IN (SELECT case_id FROM eval_runs WHERE status = 'ok' AND case_id IS NOT NULL)")
def j14(spark, folder):
    """Cases without a run that is ok."""
    return incremental.pending(table(spark, folder, "cases").filter("case_id is not null"), table(spark, folder, "eval_runs"), "case_id", "status").select("case_id").distinct()


@_query("j15_attempted", "SELECT DISTINCT case_id FROM cases WHERE case_id IN (SELECT case_id FROM eval_runs)")
def j15(spark, folder):
    """Cases with a run of any status."""
    return table(spark, folder, "cases").join(table(spark, folder, "eval_runs").select("case_id"), "case_id", "left_semi").select("case_id").distinct()


@_query("j09_first_key_lookup", f"SELECT c.case_id AS case_id, p.first_id AS first_id FROM (SELECT DISTINCT case_id, {_TKEY.format('manuscript.title')} AS k FROM cases) c JOIN (SELECT {_TKEY.format('manuscript.title')} AS k, min(case_id) AS first_id FROM cases GROUP BY 1) p ON p.k = c.k WHERE c.k <> ''")
def j09(spark, folder):
    """Each case with the first case of its title key."""
    t = table(spark, folder, "cases").select("case_id", text.title_key(F.col("manuscript.title")).alias("k")).filter("k <> ''").distinct()
    return t.join(t.groupBy("k").agg(F.min("case_id").alias("first_id")), "k").select("case_id", "first_id")


@_query("u03_last_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def u03(spark, folder):
    """The last event of each user and type."""
    return incremental.last_wins(table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@_query("u04_first_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def u04(spark, folder):
    """The first event of each user and type."""
    return incremental.first_wins(table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@_query("u02_keyword_union", f"SELECT paper_id, list_slice(list_distinct_ordered, 1, 12) AS terms FROM (SELECT paper_id, list_transform(list_filter(list_zip(t, generate_series(1, len(t))), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_ordered FROM (SELECT paper_id, {_TERMS.format('title')} || {_TERMS.format(chr(99) + 'oalesce(meta_review, ' + chr(39) * 2 + ')')} AS t FROM proreview))")
def u02(spark, folder):
    """Terms of title and meta review, distinct in the order of first mention, twelve at most."""
    t = F.concat(text.terms(F.col("title")), text.terms(F.coalesce("meta_review", F.lit(""))))
    return table(spark, folder, "proreview").select("paper_id", F.slice(F.array_distinct(t), 1, 12).alias("terms"))


@_query("u06_set_difference", "SELECT case_id, received_at, list_sort(list_filter(list_distinct(e), lambda x: NOT list_contains(p, x))) AS lost FROM (SELECT case_id, received_at, list_filter(flatten(list_transform(gold.issues, lambda i: coalesce(i.evidence_paragraph_ids, []))), lambda x: x IS NOT NULL) AS e, coalesce(list_transform(manuscript.paragraphs, lambda x: x.paragraph_id), []) AS p FROM cases WHERE gold.issues IS NOT NULL AND NOT list_contains(list_transform(gold.issues, lambda i: i IS NULL), true)) WHERE e IS NOT NULL")
def u06(spark, folder):
    """Evidence ids of a case that its paragraphs don't have, by array functions within the row."""
    ids = F.filter(F.flatten(F.transform("gold.issues", lambda i: F.coalesce(i["evidence_paragraph_ids"], F.array().cast("array<string>")))), lambda x: x.isNotNull())
    t = table(spark, folder, "cases").filter("gold.issues is not null and not exists(gold.issues, i -> i is null)").select("case_id", "received_at", ids.alias("e"), F.coalesce(F.col("manuscript.paragraphs.paragraph_id"), F.array().cast("array<string>")).alias("p"))
    return t.select("case_id", "received_at", F.array_sort(F.array_except(F.array_distinct("e"), "p")).alias("lost"))


# ---- windows, order, sampling ----


@_query("w05_tertiles", "SELECT s_suppkey, ntile(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS tertile FROM supplier")
def w05(spark, folder):
    """Tertiles within each nation."""
    t = group_row_number(table(spark, folder, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], "rn", "n")
    return t.select("s_suppkey", tile(F.col("rn"), F.col("n"), 3).alias("tertile"))


@_query("w09_decay", "SELECT s_suppkey, greatest(1, least(100, floor(100 - (rn - 1) * 70 / greatest(1, n - 1) + 0.5))) AS score FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def w09(spark, folder):
    """Scores that fall with the place in the list."""
    t = group_row_number(table(spark, folder, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], "rn", "n")
    rn, n = F.col("rn"), F.col("n")
    return t.select("s_suppkey", F.greatest(F.lit(1), F.least(F.lit(100), F.floor(100 - (rn - 1) * 70 / F.greatest(F.lit(1), n - 1) + 0.5))).alias("score"))


_PARA = "(SELECT case_id, p, no FROM (SELECT case_id, unnest(manuscript.paragraphs) AS p, generate_subscripts(manuscript.paragraphs, 1) AS no FROM (SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1)))"


@_query("w10_running_budget", f"SELECT case_id, CAST(no - 1 AS INTEGER) AS place, least(length(p.text), 600 - coalesce(before, 0)) AS kept FROM (SELECT *, sum(length(p.text)) OVER (PARTITION BY case_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_PARA} WHERE p.text IS NOT NULL) WHERE coalesce(before, 0) < 600")
def w10(spark, folder):
    """The paragraphs of each case up to 600 characters, the last one cut."""
    t = incremental.last_wins(table(spark, folder, "cases").filter("case_id is not null").select("case_id", "received_at", F.col("manuscript.paragraphs.text").alias("texts")), ["case_id"], ["received_at"])
    p = t.select("case_id", F.posexplode("texts").alias("place", "text")).filter("text is not null")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("case_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("before", before).filter("before < 600").select("case_id", "place", F.least(F.length("text"), 600 - F.col("before")).alias("kept"))


_LINES = "(SELECT paper_id, unnest(string_split(markdown.content, chr(10))) AS line, generate_subscripts(string_split(markdown.content, chr(10)), 1) AS no FROM proreview WHERE markdown.content IS NOT NULL)"


@_query("t02_sections", f"SELECT paper_id, CAST(s AS INTEGER) AS section_no, max(CASE WHEN h THEN trim(regexp_replace(line, '^ {{0,3}}#+[[:space:]]+', '')) END) AS heading, count(*) - 1 AS lines FROM (SELECT *, sum(h::INTEGER) OVER (PARTITION BY paper_id ORDER BY no) AS s FROM (SELECT *, regexp_matches(line, '^ {{0,3}}#{{1,6}}[[:space:]]+[^[:space:]]') AS h FROM {_LINES})) WHERE s > 0 GROUP BY 1, 2")
def t02(spark, folder):
    """Markdown sections by a running count of headings; what stands before the first is left out."""
    lines = table(spark, folder, "proreview").select("paper_id", F.posexplode(F.split("markdown.content", "\n")).alias("no", "line"))
    h = F.col("line").rlike(r"^ {0,3}#{1,6}\s+\S")
    t = lines.withColumn("h", h).withColumn("section_no", F.sum(F.col("h").cast("int")).over(Window.partitionBy("paper_id").orderBy("no")).cast("int")).filter("section_no > 0")
    return t.groupBy("paper_id", "section_no").agg(F.max(F.when(F.col("h"), F.trim(F.regexp_replace("line", r"^ {0,3}#+\s+", "")))).alias("heading"), (F.count("*") - 1).alias("lines"))


_ABSTRACT = "'(?ims)^#{1,4}[ ]*Abstract[^\\n]*\\n(.*?)\\n#{1,4}[ ]'"


@_query("t06_abstract", f"SELECT paper_id, substring(trim(regexp_replace(CASE WHEN regexp_matches(markdown.content || chr(10) || '# ', {_ABSTRACT}) THEN regexp_extract(markdown.content || chr(10) || '# ', {_ABSTRACT}, 1) ELSE markdown.content END, '[[:space:]]+', ' ', 'g')), 1, 1024) AS abstract FROM proreview WHERE markdown.content IS NOT NULL")
def t06(spark, folder):
    """The text under the heading of the abstract, or the whole text where there is no such heading."""
    t = table(spark, folder, "proreview").filter("markdown.content is not null")
    content, pattern = F.concat("markdown.content", F.lit("\n# ")), r"(?ims)^#{1,4}[ ]*Abstract[^\n]*\n(.*?)\n#{1,4}[ ]"
    body = F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 1)).otherwise(F.col("markdown.content"))
    return t.select("paper_id", F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, 1024).alias("abstract"))


@_query("w14_top_reviews", f"SELECT paper_id, review_id, confidence FROM {REVIEWS_SQL} QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC NULLS LAST, review_id) <= 2")
def w14(spark, folder):
    """The two most confident reviews of each paper."""
    return top_per_group(reviews(spark, folder), ["paper_id"], [F.desc_nulls_last("confidence"), F.col("review_id")], 2).select("paper_id", "review_id", "confidence")


@_query("w15_dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY created_at NULLS FIRST, doc_id) AS number FROM documents")
def w15(spark, folder):
    """Row numbers over the whole table, made without one task for all."""
    return global_row_number(table(spark, folder, "documents").select("doc_id", "created_at"), [F.col("created_at"), F.col("doc_id")], "number").select("doc_id", "number")


@_query("x03_batches", "SELECT case_id, run_id, CAST(floor((rn - 1) / 4) AS BIGINT) AS batch_no, CAST((rn - 1) % 4 AS INTEGER) AS place FROM (SELECT DISTINCT case_id, run_id FROM eval_runs) JOIN (SELECT run_id AS r2, row_number() OVER (PARTITION BY case_id ORDER BY run_id) AS rn FROM (SELECT DISTINCT case_id, run_id FROM eval_runs)) ON r2 = run_id")
def x03(spark, folder):
    """Each case's runs in batches of four."""
    return incremental.in_batches(table(spark, folder, "eval_runs").select("case_id", "run_id").distinct(), "case_id", ["run_id"], 4).select("case_id", "run_id", "batch_no", "place")


@_query("o05_evenly_spaced", "SELECT CAST(i AS INTEGER) AS sample_no, p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place, count(*) OVER () AS n FROM part), range(20) t(i) WHERE place = floor(i * (n - 1) / 19 + 0.5)")
def o05(spark, folder):
    """Twenty parts at even distances of the price order."""
    return evenly_spaced(table(spark, folder, "part"), [F.col("p_retailprice"), F.col("p_partkey")], 20).select("sample_no", "p_partkey")


@_query("o08_stratified_quota", f"SELECT paper_id, label, year FROM {PAPERS_SQL} WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY (year = 2025) DESC NULLS LAST, sha256('42|' || label || '|' || paper_id), paper_id) <= CASE label WHEN 1 THEN 25 ELSE 20 END")
def o08(spark, folder):
    """A quota of papers per label in hash order, those of 2025 first."""
    p = papers(spark, folder).filter("label is not null").select("paper_id", "label", "year")
    return stratified_quota(p, ["label"], "paper_id", {("0",): 20, ("1",): 25}, "42", F.col("year") == 2025)


@_query("o13_band_diverse", "SELECT s_suppkey, s_nationkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS b FROM supplier) ORDER BY (b = 1) DESC, s_acctbal DESC, s_suppkey LIMIT 30")
def o13(spark, folder):
    """The best supplier of each nation first, then the best of the rest, thirty in all."""
    t = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return band_diverse(t, "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")], 30)


# ---- guards ----


@_query(
    "k04_violations",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'total price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END, CASE WHEN NOT coalesce(o_custkey IS NOT NULL, false) THEN 'customer' END], lambda x: x IS NOT NULL)) AS message FROM orders
       UNION ALL SELECT review_id, 'repeated key' FROM review_scores GROUP BY 1 HAVING count(*) > 1
       UNION ALL SELECT DISTINCT a_id, 'no such target' FROM pairs WHERE a_id NOT IN (SELECT paper_id FROM proreview WHERE paper_id IS NOT NULL)""",
)
def k04(spark, folder):
    """Broken row rules, repeated keys and dangling references as rows."""
    rules = {"total price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F"), "customer": F.col("o_custkey").isNotNull()}
    return validation.all_of(
        validation.violations(table(spark, folder, "orders"), "o_orderkey", rules),
        validation.repeated_keys(table(spark, folder, "review_scores"), "review_id"),
        validation.missing_references(table(spark, folder, "pairs"), "a_id", table(spark, folder, "proreview"), "paper_id"),
    )


@_query("k01_leaking_venues", "SELECT case_id, source.venue_id AS venue_id FROM cases WHERE regexp_matches(lower(source.venue_id), 'reject|withdraw|poster|spotlight|oral|accept')")
def k01(spark, folder):
    """Cases whose venue gives the decision away."""
    return table(spark, folder, "cases").select("case_id", F.col("source.venue_id").alias("venue_id")).filter(F.lower("venue_id").rlike("reject|withdraw|poster|spotlight|oral|accept"))


@_query("k03_class_guard", f"SELECT year, count(*) AS n, count(DISTINCT label) AS classes, count(*) >= 10 AND count(DISTINCT label) = 2 AS usable FROM {PAPERS_SQL} WHERE label IS NOT NULL GROUP BY 1")
def k03(spark, folder):
    """Whether each year has both classes and enough rows to learn from."""
    return papers(spark, folder).filter("label is not null").groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes")).withColumn("usable", (F.col("n") >= 10) & (F.col("classes") == 2))


# ---- models and JSON by Arrow batches ----


@_query("x08_scorer", "SELECT doc_id, round(('0x' || substr(sha256(text), 1, 8))::UBIGINT::DOUBLE / 4294967295 * 8 - 4, 6) AS score FROM documents WHERE text IS NOT NULL")
def x08(spark, folder):
    """Documents through the interface of models, with the mock."""
    return score(table(spark, folder, "documents").filter("text is not null"), "doc_id", "text", "mock")


def repaired(spark, folder):
    """Cut-off JSON answers closed: the repaired text and whether it parses."""
    import pandas as pd

    def step(batches):
        for b in batches:
            closed = b["raw_output"].map(close_json)
            yield pd.DataFrame({"run_id": b["run_id"], "closed": closed, "parses": closed.map(lambda t: t is not None and parses(t))})

    return table(spark, folder, "eval_runs").select("run_id", "raw_output").mapInPandas(step, "run_id bigint, closed string, parses boolean")


QUERIES["f61_close_json"] = repaired
