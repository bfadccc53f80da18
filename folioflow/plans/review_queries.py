"""Queries of documents' parts, of gold comparisons, and of tables that compare runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import hashing, text
from folioflow.functions.numbers import ratio
from folioflow.operators import calibration, extract, metrics, similarity
from folioflow.operators.sampling import top_per_group
from folioflow.plans.rank_queries import _COSINE_SQL, _TFIDF_SQL, title_vectors
from folioflow.plans.table_queries import _SAID_SQL, PAPERS_SQL, REVIEWS_SQL, papers, reviews, verdicts
from folioflow.plans.text_queries import ORACLE as _TEXT
from folioflow.sources.tables import table
from folioflow.streaming.incremental import last_wins

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@_query("t01_segments")
def t01(spark, folder):
    """Documents as numbered sections and paragraphs."""
    return extract.segments(table(spark, folder, "documents"), "doc_id", "text")


@_query("t05_evidence_fields")
def t05(spark, folder):
    """Four fields of evidence per paper."""
    return extract.evidence_fields(table(spark, folder, "proreview").select("paper_id", F.col("markdown.content").alias("content")), "paper_id", "content")


@_query("o16_section_priority", "SELECT case_id, paragraph_id FROM (SELECT case_id, p.paragraph_id AS paragraph_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN contains(lower(p.section), 'abstract') THEN 0 WHEN contains(lower(p.section), 'method') THEN 1 WHEN contains(lower(p.section), 'result') THEN 2 ELSE 9 END, no) AS rn FROM (SELECT case_id, unnest(manuscript.paragraphs) AS p, generate_subscripts(manuscript.paragraphs, 1) AS no FROM (SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1))) WHERE rn <= 3")
def o16(spark, folder):
    """The three paragraphs of the most wanted sections of each case."""
    t = last_wins(table(spark, folder, "cases").filter("case_id is not null").select("case_id", "received_at", F.col("manuscript.paragraphs").alias("ps")), ["case_id"], ["received_at"])
    p = t.select("case_id", F.posexplode("ps").alias("no", "p")).select("case_id", "no", "p.section", "p.paragraph_id")
    s = F.lower("section")
    rank = F.when(s.contains("abstract"), 0).when(s.contains("method"), 1).when(s.contains("result"), 2).otherwise(9)
    return top_per_group(p, ["case_id"], [rank, F.col("no")], 3).select("case_id", "paragraph_id")


@_query("p14_drop_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN rating IS NULL THEN 'no_rating' WHEN label IS NULL THEN 'no_label' ELSE 'kept' END AS reason FROM " + PAPERS_SQL + ") GROUP BY 1")
def p14(spark, folder):
    """Why papers would be left out, the first reason that applies."""
    reason = F.when(F.col("title").isNull() | (F.trim("title") == ""), "no_title").when(F.col("rating").isNull(), "no_rating").when(F.col("label").isNull(), "no_label").otherwise("kept")
    return papers(spark, folder).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@_query("p17_enough_reviews", f"SELECT paper_id, len(rs) AS reviews FROM {PAPERS_SQL} WHERE len(rs) >= 8")
def p17(spark, folder):
    """Papers of at least eight ratings."""
    return papers(spark, folder).select("paper_id", F.size("rs").alias("reviews")).filter("reviews >= 8")


@_query("p18_blind", "SELECT 'paper-' || substr(sha256('blind|' || paper_id), 1, 16) AS blind_id, title FROM proreview")
def p18(spark, folder):
    """Titles under keyed hashes in place of ids."""
    return table(spark, folder, "proreview").select(hashing.short_id(F.concat(F.lit("blind|"), "paper_id"), "paper-", 16).alias("blind_id"), "title")


@_query("j16_matched_pairs", f"WITH {_TFIDF_SQL}, {_COSINE_SQL} SELECT c.query AS query, c.id AS id, round(c.cosine, 6) AS cosine FROM c JOIN {PAPERS_SQL} x ON x.paper_id = c.query JOIN {PAPERS_SQL} y ON y.paper_id = c.id WHERE x.label <> y.label AND abs(x.year - y.year) <= 1 AND round(c.cosine, 9) >= 0.25")
def j16(spark, folder):
    """Papers of the other label, at most a year apart, with titles at least 0.25 alike; the queries are the ids divisible by 20."""
    v = title_vectors(spark, folder)
    c = similarity.cosines(v.filter(F.col("id").cast("bigint") % 20 == 0), v).filter(F.round("cosine", 9) >= 0.25)
    p = papers(spark, folder).select("paper_id", "label", "year")
    x = p.select(F.col("paper_id").alias("query"), F.col("label").alias("lx"), F.col("year").alias("yx"))
    y = p.select(F.col("paper_id").alias("id"), F.col("label").alias("ly"), F.col("year").alias("yy"))
    return c.join(x, "query").join(y, "id").filter("lx <> ly and abs(yx - yy) <= 1").select("query", "id", F.round("cosine", 6).alias("cosine"))


_BODY = _TEXT["f59_json_body"].split(" AS body")[0].split("run_id, ", 1)[1]
_CONCERN = '[{"category":"VARCHAR","evidence":[{"paragraph_id":"VARCHAR"}]}]'
_CONCERNS = "'" + '{"major_concerns":' + _CONCERN + ',"minor_concerns":' + _CONCERN + "}'"
_SEVERE = "list_transform(coalesce(t.{0}_concerns, []), lambda c: {{'severity': '{0}', 'category': c.category, 'evidence': c.evidence}})"
_MATCH_SQL = f"""r AS (SELECT DISTINCT run_id, case_id, list_concat({_SEVERE.format("major")}, {_SEVERE.format("minor")}) AS cs FROM (SELECT run_id, case_id, json_transform(body, {_CONCERNS}) AS t FROM (SELECT run_id, case_id, {_BODY} AS body FROM eval_runs WHERE status = 'ok') WHERE json_valid(body))),
    p AS (SELECT run_id, case_id, c.severity AS severity, c.category AS category, list_transform(coalesce(c.evidence, []), lambda e: e.paragraph_id) AS ids, no FROM (SELECT run_id, case_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS no FROM r)),
    g AS (SELECT case_id, i.severity AS severity, coalesce(i.acceptable_categories, [i.category]) AS cats, list_filter(coalesce(i.evidence_paragraph_ids, []), lambda x: x IS NOT NULL) AS ids, no AS g FROM (SELECT case_id, unnest(gold.issues) AS i, generate_subscripts(gold.issues, 1) AS no FROM (SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1)) WHERE i IS NOT NULL),
    m AS (SELECT run_id, g.g, min(p.no) AS first FROM p JOIN g ON g.case_id = p.case_id AND g.severity = p.severity AND list_contains(g.cats, p.category) AND (len(g.ids) = 0 OR list_has_any(g.ids, p.ids)) GROUP BY 1, 2)"""


def gold_matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The concerns of each sound answer, the gold issues of each case, and which concern is the first to match an issue.

    A concern, major or minor by the list it stands in, matches an issue of its
    severity in one of its categories that shares a paragraph with it; an issue without paragraphs needs none. Issues are matched
    once, a concern may match several.
    """
    concerns = "array<struct<category: string, evidence: array<struct<paragraph_id: string>>>>"
    schema = f"struct<major_concerns: {concerns}, minor_concerns: {concerns}>"
    body = F.from_json(text.json_body(F.col("raw_output")), schema, {"mode": "PERMISSIVE"})

    def listed(severity: str) -> Column:
        return F.transform(F.coalesce(body[f"{severity}_concerns"], F.array().cast(concerns)), lambda c: F.struct(F.lit(severity).alias("severity"), c["category"].alias("category"), c["evidence"].alias("evidence")))

    runs = table(spark, folder, "eval_runs").filter("status = 'ok'").select("run_id", "case_id", F.concat(listed("major"), listed("minor")).alias("cs")).distinct()
    p = runs.select("run_id", "case_id", F.posexplode("cs").alias("no", "c")).select("run_id", "case_id", "no", "c.severity", "c.category", F.coalesce("c.evidence.paragraph_id", F.array().cast("array<string>")).alias("ids"))
    cases = last_wins(table(spark, folder, "cases").filter("case_id is not null").select("case_id", "received_at", F.col("gold.issues").alias("issues")), ["case_id"], ["received_at"])
    g = cases.select("case_id", F.posexplode("issues").alias("g", "i")).filter("i is not null")
    ids = F.filter(F.coalesce("i.evidence_paragraph_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())
    g = g.select("case_id", "g", F.col("i.severity").alias("severity"), F.coalesce("i.acceptable_categories", F.array("i.category")).alias("cats"), ids.alias("gold_ids"))
    met = p.join(g, ["case_id", "severity"]).filter(F.array_contains("cats", F.col("category")) & ((F.size("gold_ids") == 0) | F.arrays_overlap("gold_ids", "ids")))
    return p, g, met.groupBy("run_id", "g").agg(F.min("no").alias("first"))


@_query(
    "m27_issue_matching",
    f"""WITH {_MATCH_SQL}, n AS (SELECT run_id, case_id, count(*) AS predicted FROM p GROUP BY 1, 2), k AS (SELECT case_id, count(*) AS expected FROM g GROUP BY 1), h AS (SELECT run_id, count(*) AS matched, count(DISTINCT first) AS used FROM m GROUP BY 1)
        SELECT run_id, predicted, expected, coalesce(matched, 0) AS matched, round(coalesce(used, 0) / predicted, 6) AS precision, round(coalesce(matched, 0) / expected, 6) AS recall FROM n JOIN k USING (case_id) LEFT JOIN h USING (run_id)""",
)
def m27(spark, folder):
    """Precision and recall of each answer's concerns against the gold issues of its case."""
    p, g, m = gold_matches(spark, folder)
    n = p.groupBy("run_id", "case_id").agg(F.count("*").alias("predicted"))
    k = g.groupBy("case_id").agg(F.count("*").alias("expected"))
    h = m.groupBy("run_id").agg(F.count("*").alias("matched"), F.count_distinct("first").alias("used"))
    t = n.join(k, "case_id").join(h, "run_id", "left").na.fill(0, ["matched", "used"])
    return t.select("run_id", "predicted", "expected", "matched", F.round(ratio(F.col("used"), F.col("predicted")), 6).alias("precision"), F.round(ratio(F.col("matched"), F.col("expected")), 6).alias("recall"))


_UNORDERED = f"(SELECT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y, CASE WHEN said = 'tie' THEN 'tie' WHEN (said = 'A') = (a_id < b_id) THEN 'x' ELSE 'y' END AS won FROM pairs JOIN {_SAID_SQL} USING (pair_id) WHERE said IS NOT NULL AND a_id <> b_id)"


@_query("m15_repeat_consistency", f"SELECT n AS judged, count(*) AS couples, count_if(kinds = 1) AS consistent, round(count_if(kinds = 1) / count(*), 6) AS share FROM (SELECT x, y, count(*) AS n, count(DISTINCT won) AS kinds FROM {_UNORDERED} GROUP BY 1, 2) GROUP BY 1")
def m15(spark, folder):
    """How often couples that were judged several times, in either order, got one verdict."""
    t = table(spark, folder, "pairs").filter("a_id <> b_id").join(verdicts(spark, folder).filter("said is not null"), "pair_id")
    won = F.when(F.col("said") == "tie", "tie").when((F.col("said") == "A") == (F.col("a_id") < F.col("b_id")), "x").otherwise("y")
    c = t.groupBy(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).agg(F.count("*").alias("judged"), F.count_distinct(won).alias("kinds"))
    return c.groupBy("judged").agg(F.count("*").alias("couples"), F.count_if(F.col("kinds") == 1).alias("consistent")).withColumn("share", F.round(F.col("consistent") / F.col("couples"), 6))


@_query("m17_median_gap", f"WITH t AS (SELECT rts_gap, said FROM pairs JOIN {_SAID_SQL} USING (pair_id) WHERE said IS NOT NULL AND rts_gap IS NOT NULL), m AS (SELECT quantile_disc(rts_gap, 0.5) AS g FROM t) SELECT CASE WHEN rts_gap < g THEN 'small' ELSE 'large' END AS gap, count(*) AS pairs, round(avg((said = 'A')::INTEGER), 6) AS a_rate, round(avg((said = 'tie')::INTEGER), 6) AS tie_rate FROM t, m GROUP BY 1")
def m17(spark, folder):
    """Verdicts below and from the median gap on."""
    t = table(spark, folder, "pairs").filter("rts_gap is not null").join(verdicts(spark, folder).filter("said is not null"), "pair_id")
    m = t.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rts_gap)").alias("g"))
    rate = lambda x: F.round(F.avg((F.col("said") == x).cast("int")), 6)
    return t.crossJoin(F.broadcast(m)).groupBy(F.when(F.col("rts_gap") < F.col("g"), "small").otherwise("large").alias("gap")).agg(F.count("*").alias("pairs"), rate("A").alias("a_rate"), rate("tie").alias("tie_rate"))


@_query("k02_signatures", "SELECT case_schema_version AS signature, count(*) AS n, count(DISTINCT case_schema_version) OVER () = 1 AS single FROM cases GROUP BY 1")
def k02(spark, folder):
    """The schema versions in the table, and whether there is just one."""
    t = table(spark, folder, "cases").groupBy(F.col("case_schema_version").alias("signature")).agg(F.count("*").alias("n"))
    kinds = t.agg((F.count("signature") == 1).alias("single"))
    return t.crossJoin(F.broadcast(kinds))


@_query("m24_non_inferiority", f"WITH v AS (SELECT reviewer_id, avg(abs(rating - m)) AS error FROM (SELECT reviewer_id, rating, avg(rating) OVER (PARTITION BY paper_id) AS m FROM {REVIEWS_SQL}) WHERE reviewer_id IS NOT NULL AND rating IS NOT NULL GROUP BY 1), b AS (SELECT avg(error) AS base FROM v) SELECT reviewer_id, round(error, 6) AS error, error <= base + 0.2 AS not_worse FROM v, b")
def m24(spark, folder):
    """Each reviewer's mean distance from the papers' means, and whether it is within a margin of the average."""
    r = reviews(spark, folder).select("paper_id", "reviewer_id", "rating")
    means = r.groupBy("paper_id").agg(F.avg("rating").alias("m"))
    v = r.filter("reviewer_id is not null and rating is not null").join(means, "paper_id").groupBy("reviewer_id").agg(F.avg(F.abs(F.col("rating") - F.col("m"))).alias("error"))
    return v.crossJoin(F.broadcast(v.agg(F.avg("error").alias("base")))).select("reviewer_id", F.round("error", 6).alias("error"), (F.col("error") <= F.col("base") + 0.2).alias("not_worse"))


@_query("c03_platt")
def c03(spark, folder):
    """Mock scores calibrated on the papers up to 2024 by a logistic of one feature, measured on the later ones."""
    p = papers(spark, folder).filter("label is not null").select("paper_id", "label", "year", "rating")
    p = p.filter("rating is not null").withColumn("score", F.col("rating") - 5.5)
    slope, intercept = calibration.platt(p.filter("year <= 2024"), "score", "label")
    later = p.filter("year > 2024").withColumn("p", 1 / (1 + F.exp(-calibration.linear(["score"], [slope], intercept))))
    m = metrics.probability_metrics(later, "label", "p").crossJoin(metrics.expected_calibration_error(later, "label", "p"))
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("brier", "log_loss", "accuracy", "ece")])
