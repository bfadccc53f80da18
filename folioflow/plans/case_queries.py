"""Queries of case building, of what reviews contain, of rankings compared, and of orders and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import hashing, text
from folioflow.functions.numbers import ratio, sigmoid
from folioflow.operators import calibration, cases, fusion, metrics, validation
from folioflow.operators.ranks import global_row_number, group_row_number, quantiles
from folioflow.plans.rank_queries import _BATCHED, _rankings
from folioflow.plans.review_queries import _BODY
from folioflow.plans.table_queries import _HITS, _PAIRS_SQL, _SAID_SQL, PAPERS_SQL, papers, verdicts
from folioflow.plans.text_queries import _stem_sql, _words
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


# ---- case building ----

_MAIL, _LINK, _ORCID = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)https?://[a-z0-9.-]+/profile\?id=[^\s)]+", r"(?i)(^|[^0-9A-Za-z_])[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]($|[^0-9A-Za-z_])"


def _plain_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '{_MAIL}', '[EMAIL]', 'g'), '{_LINK}', '[PROFILE]', 'g'), '{_ORCID}', '\1[ORCID]\2', 'g'), '\s+', ' ', 'g'))"


def _rank_sql(heading: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({heading}), '{w}') THEN {i}" for i, w in enumerate(words)) + f" ELSE {len(words)} END"


# Sections of one to three marks, as lists of heading and body, those left out gone.
_CHAPTERS = rf"""list_filter(list_transform(list_filter(string_split(regexp_replace(chr(10) || coalesce(markdown.content, ''), '\n(#{{1,3}}\s+\S)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^#{{1,3}}\s+\S')),
    lambda x: {{'heading': left({_plain_sql(r"regexp_extract(x, '^#{1,3}\s+([^\n]*)', 1)")}, 280), 'body': regexp_replace(x, '^[^\n]*\n?', '')}}), lambda x: NOT regexp_matches(x.heading, '(?i)acknowledg|references|bibliography|appendix'))"""
_BLOCKS = rf"list_filter(list_transform(string_split(regexp_replace({{0}}, '\n\s*\n', chr(2), 'g'), chr(2)), lambda b: {_plain_sql('b')}), lambda b: b <> '')"


def _packs_sql(x: str, longer_than: int, most: int) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(3), 'g'), chr(3))"
    full = f"a.now <> '' AND length(trim(a.now || ' ' || y)) > {most}"
    return f"CASE WHEN length({x}) <= {longer_than} THEN [{x}] ELSE list_filter(list_transform([list_reduce({parts}, lambda a, y: {{'done': CASE WHEN {full} THEN list_append(a.done, a.now) ELSE a.done END, 'now': CASE WHEN {full} THEN y ELSE trim(a.now || ' ' || y) END}}, {{'done': []::VARCHAR[], 'now': ''}})], lambda r: list_append(r.done, r.now))[1], lambda y: y <> '') END"


_OF = f"flatten(list_transform(list_filter({_BLOCKS}, lambda b: length(b) >= 60), lambda b: {_packs_sql('b', 1200, 1000)}))"
_CASE_PARAGRAPHS = f"""(SELECT paper_id, no, s.heading AS section, t AS text, p FROM (SELECT paper_id, no, s, unnest(s.blocks) AS t, generate_subscripts(s.blocks, 1) AS p FROM (
    SELECT paper_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS no FROM (SELECT paper_id, CASE WHEN len(made) > 0 THEN made ELSE [{{'heading': 'Manuscript', 'blocks': {_OF.replace("{0}", "coalesce(markdown.content, '')")}}}] END AS ss FROM (
    SELECT paper_id, markdown, list_filter(list_transform({_CHAPTERS}, lambda c: {{'heading': c.heading, 'blocks': {_OF.replace("{0}", "c.body")}}}), lambda c: len(c.blocks) > 0) AS made FROM proreview)))))"""


def _markdown(spark, folder) -> DataFrame:
    return table(spark, folder, "proreview").select("paper_id", "title", F.col("markdown.content").alias("content"))


@_query(
    "t07_case_paragraphs",
    f"""SELECT paper_id, CAST(place AS INTEGER) AS place, section, printf('section-%02d-p%03d', no, p) AS paragraph_id, left(text, least(1200, 24000 - used)::BIGINT) AS text FROM (
        SELECT *, row_number() OVER w AS place, coalesce(sum(least(length(text), 1200)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {_CASE_PARAGRAPHS} WINDOW w AS (PARTITION BY paper_id ORDER BY {_rank_sql('section', cases.CASE_PRIORITY)}, no, p)) WHERE 24000 - used >= 60 AND place <= 80""",
)
def t07(spark, folder):
    """Each paper's paragraphs, wanted sections first, within the budget of a case."""
    return cases.case_paragraphs(_markdown(spark, folder), "paper_id", "content")


@_query(
    "t08_alignment_paragraphs",
    f"""SELECT paper_id, s.heading AS section, printf('section-%02d-p%03d', no, p) AS paragraph_id, left(t, 900) AS text FROM (SELECT paper_id, no, s, unnest(bs) AS t, generate_subscripts(bs, 1) AS p FROM (
        SELECT paper_id, no, s, flatten(list_transform({_BLOCKS.replace("{0}", "s.body")}, lambda b: {_packs_sql('b', 700, 650)})) AS bs FROM (SELECT paper_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS no FROM (SELECT paper_id, {_CHAPTERS} AS ss FROM proreview)))) WHERE length(t) >= 80""",
)
def t08(spark, folder):
    """Each paper's paragraphs for alignment with review items."""
    return cases.alignment_paragraphs(_markdown(spark, folder), "paper_id", "content")


@_query(
    "t09_excerpt",
    f"""WITH c AS (SELECT paper_id, {_plain_sql("markdown.content")} AS plain, list_filter(list_transform({_CHAPTERS}, lambda c: {{'heading': c.heading, 'body': {_plain_sql("c.body")}}}), lambda c: c.body <> '') AS made FROM proreview),
        d AS (SELECT paper_id, CASE WHEN len(made) > 0 THEN made WHEN plain <> '' THEN [{{'heading': 'Manuscript', 'body': plain}}] ELSE [] END AS parts FROM c),
        e AS (SELECT paper_id, list_slice(list_sort(list_transform(parts, lambda x, i: {{'a': {_rank_sql("x.heading", cases.EXCERPT_PRIORITY)}, 'b': i, 'heading': x.heading, 'body': x.body}})), 1, 8) AS ch FROM d)
        SELECT paper_id, left(array_to_string(list_transform(ch, lambda x: '## ' || x.heading || chr(10) || left(x.body, greatest(160, floor(3000 / greatest(len(ch), 1)))::BIGINT)), chr(10) || chr(10)), 3000) AS excerpt FROM e""",
)
def t09(spark, folder):
    """The most wanted sections of each paper in 3,000 characters."""
    return _markdown(spark, folder).select("paper_id", cases.excerpt(F.col("content"), 3000).alias("excerpt"))


@_query(
    "t10_document_manuscripts",
    r"""SELECT doc_id, CAST(len(bs) AS INTEGER) AS paragraphs, sha256(array_to_string(bs, chr(10))) AS fingerprint FROM (SELECT doc_id, list_slice(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 20), 1, 80) AS bs FROM documents)""",
)
def t10(spark, folder):
    """How many paragraphs a document has as a manuscript, and the digest of their text."""
    parts = cases.document_paragraphs(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(parts).alias("paragraphs"), F.sha2(F.array_join(parts, "\n"), 256).alias("fingerprint"))


_CASES = "(SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1)"
_PARAGRAPHS = f"(SELECT case_id, p.section AS section, p.paragraph_id AS paragraph_id, p.text AS text, no FROM (SELECT case_id, unnest(manuscript.paragraphs) AS p, generate_subscripts(manuscript.paragraphs, 1) AS no FROM {_CASES}) WHERE p IS NOT NULL)"


def _paragraphs(spark, folder) -> DataFrame:
    t = last_wins(table(spark, folder, "cases").filter("case_id is not null").select("case_id", "received_at", F.col("manuscript.paragraphs").alias("ps")), ["case_id"], ["received_at"])
    return t.select("case_id", F.posexplode("ps").alias("no", "p")).filter("p is not null").select("case_id", "no", "p.section", "p.paragraph_id", "p.text")


_SIZE = "length('paragraph_id: ' || coalesce(paragraph_id, '') || chr(10) || 'section: ' || coalesce(section, '') || chr(10) || 'text: ' || coalesce(text, ''))"


@_query(
    "t17_paragraph_input",
    f"""SELECT case_id, count(*) AS total_paragraphs, count_if(taken) AS analyzed_paragraphs, CAST(sum(CASE WHEN taken THEN counted ELSE 0 END) AS BIGINT) AS supplied_characters, count_if(taken) < count(*) AS truncated, count(DISTINCT CASE WHEN taken THEN section END) AS analyzed_sections, count(DISTINCT CASE WHEN NOT taken THEN section END) AS omitted_sections FROM (
        SELECT *, sum(counted) OVER (PARTITION BY case_id ORDER BY no) <= 600 AND rn <= 6 AS taken FROM (SELECT *, CASE WHEN rn = 1 THEN least({_SIZE}, 600) ELSE {_SIZE} END AS counted FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY no) AS rn FROM {_PARAGRAPHS}))) GROUP BY 1""",
)
def t17(spark, folder):
    """What of each case goes into a prompt of 600 characters and six paragraphs, and what is left out."""
    of = lambda c: F.coalesce(c, F.lit(""))
    size = F.length(F.concat(F.lit("paragraph_id: "), of("paragraph_id"), F.lit("\nsection: "), of("section"), F.lit("\ntext: "), of("text")))
    rows = cases.within_budget(_paragraphs(spark, folder).withColumn("size", size), "case_id", "no", "size", 600, 6)
    section = lambda c: F.count_distinct(F.when(c, F.col("section")))
    out = rows.groupBy("case_id").agg(F.count("*").alias("total_paragraphs"), F.count_if("taken").alias("analyzed_paragraphs"), F.sum(F.when(F.col("taken"), F.col("counted")).otherwise(0)).cast("bigint").alias("supplied_characters"), section(F.col("taken")).alias("analyzed_sections"), section(~F.col("taken")).alias("omitted_sections"))
    return out.withColumn("truncated", F.col("analyzed_paragraphs") < F.col("total_paragraphs"))


@_query("k05_case_checks", f"SELECT case_id, count(*) - count(DISTINCT paragraph_id) - count_if(paragraph_id IS NULL) AS repeated_ids, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, coalesce(sum(length(text)), 0) > 1000 AS too_long FROM {_PARAGRAPHS} GROUP BY 1")
def k05(spark, folder):
    """Repeated paragraph ids and the length of each case."""
    n = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return _paragraphs(spark, folder).groupBy("case_id").agg((F.count("*") - F.count_distinct("paragraph_id") - F.count_if(F.col("paragraph_id").isNull())).alias("repeated_ids"), n.alias("characters"), (n > 1000).alias("too_long"))


@_query("p12_usable_papers", r"SELECT paper_id FROM proreview WHERE trim(title) <> '' AND length(markdown.content) >= 100 AND NOT regexp_matches(title, '(?i)(^|[^a-z])(survey|review|overview|bibliometric)([^a-z]|$)|综述')")
def p12(spark, folder):
    """Papers with a title that is no survey's and a text of some length."""
    return _markdown(spark, folder).filter((F.trim("title") != "") & (F.length("content") >= 100) & ~F.col("title").rlike(text.SURVEYS)).select("paper_id")


@_query("p08_substantive_reviews", "SELECT paper_id, len(list_filter(coalesce(reviews, []), lambda r: length(concat_ws(chr(10), r.summary, r.strengths, r.weaknesses, r.questions)) >= 200)) AS substantive FROM proreview")
def p08(spark, folder):
    """How many reviews of each paper say something of length."""
    long = F.filter(F.coalesce("reviews", F.array()), lambda r: F.length(F.concat_ws("\n", r["summary"], r["strengths"], r["weaknesses"], r["questions"])) >= 200)
    return table(spark, folder, "proreview").select("paper_id", F.size(long).cast("bigint").alias("substantive"))


@_query("p16_not_withdrawn", "SELECT paper_id, title, venue, year FROM " + PAPERS_SQL + " WHERE NOT contains(lower(coalesce(decision, '')), 'withdraw') AND paper_id NOT IN (SELECT paper_id FROM proreview WHERE contains(lower(metadata.venueid), 'withdraw'))")
def p16(spark, folder):
    """Papers without label and ratings, those withdrawn left out."""
    gone = table(spark, folder, "proreview").filter(F.contains(F.lower("metadata.venueid"), F.lit("withdraw"))).select("paper_id")
    return papers(spark, folder).filter(~F.contains(F.lower(F.coalesce("decision", F.lit(""))), F.lit("withdraw"))).join(gone, "paper_id", "left_anti").select("paper_id", "title", "venue", "year")


@_query("p27_relabelled", "SELECT paper_id, printf('p%06d', row_number() OVER (ORDER BY sha256('42|' || paper_id), paper_id)) AS label_id, CASE WHEN trim(coalesce(title, '')) = '' THEN '[NOT PROVIDED]' ELSE title END AS title FROM proreview")
def p27(spark, folder):
    """Papers under running ids in hash order, missing titles filled in."""
    t = global_row_number(_markdown(spark, folder).select("paper_id", "title"), [F.sha2(F.concat(F.lit("42|"), "paper_id"), 256), F.col("paper_id")], "n")
    return t.select("paper_id", F.format_string("p%06d", "n").alias("label_id"), F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "[NOT PROVIDED]").otherwise(F.col("title")).alias("title"))


@_query("f06_plain_masks", f"SELECT doc_id, {_plain_sql('text')} AS masked FROM documents")
def f06(spark, folder):
    """Documents with addresses masked briefly."""
    return table(spark, folder, "documents").select("doc_id", text.redact_plain(F.col("text")).alias("masked"))


_TERMS = ["navigation", "intent detection", "log collection", "analysis", "vision", "graph-neural", "数据", "traffic control"]
_SCOPE = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[-–—_/]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _scope_sql() -> str:
    out = []
    for t in _TERMS:
        plain = " ".join(t.lower().replace("-", " ").split())
        if " " in plain or not plain.isascii():
            out.append(f"CASE WHEN contains(s, '{plain}') THEN '{t}' END")
        elif len(plain) >= 5 and plain not in text.GENERIC_TERMS:
            out.append(f"CASE WHEN list_contains(regexp_split_to_array(s, '[^a-z0-9]+'), '{plain}') THEN '{t}' END")
    return "list_slice(list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL), 1, 8)"


@_query("f28_scope_hits", f"SELECT doc_id, array_to_string({_scope_sql()}, '|') AS hits, n AS tokens FROM (SELECT doc_id, {_SCOPE} AS s, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s,，;；、/|]+'), lambda w: length(w) >= 2)) AS n FROM documents)")
def f28(spark, folder):
    """Which terms of a scope each document names, and its parts between separators."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.scope_hits(F.col("text"), _TERMS), "|").alias("hits"), F.size(text.scope_tokens(F.col("text"))).cast("bigint").alias("tokens"))


def _key_sql(x: str) -> str:
    return rf"coalesce(trim(regexp_replace(regexp_replace(lower({x}), '&', 'and', 'g'), '[^a-z0-9\x{{3400}}-\x{{9fff}}]+', ' ', 'g')), '')"


_MATCH = "CASE WHEN a = b OR (c <> '' AND a = c) THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 80 WHEN c <> '' AND (contains(a, c) OR contains(c, a)) THEN 75 ELSE 0 END"
_LAST = "regexp_replace(metadata.venueid, '^.*/', '')"


@_query("v05_name_match", f"SELECT paper_id, {_MATCH} AS score, {_MATCH} >= 75 AS accepted FROM (SELECT paper_id, {_key_sql('metadata.venue')} AS a, {_key_sql('venue')} AS b, {_key_sql(_LAST)} AS c FROM (SELECT p.paper_id, p.metadata, x.venue FROM proreview p JOIN {PAPERS_SQL} x USING (paper_id)))")
def v05(spark, folder):
    """How well the venue a paper states fits the one of its id."""
    t = table(spark, folder, "proreview").select("paper_id", F.col("metadata.venue").alias("stated"), F.regexp_replace("metadata.venueid", "^.*/", "").alias("last")).join(papers(spark, folder).select("paper_id", "venue"), "paper_id")
    score = text.name_match(F.col("stated"), F.col("venue"), F.col("last"))
    return t.select("paper_id", score.alias("score"), (score >= 75).alias("accepted"))


# ---- what reviews contain ----

_SHAPE = """'{"summary":"VARCHAR","strengths":["VARCHAR"],"major_concerns":[{"id":"VARCHAR","category":"VARCHAR","problem":"VARCHAR","evidence":[{"paragraph_id":"VARCHAR","excerpt":"VARCHAR"}]}],"questions":["VARCHAR"],"recommendation":{"verdict":"VARCHAR","confidence":"DOUBLE"},"limitations":["VARCHAR"]}'"""
_REVIEW_SQL = f"(SELECT run_id, case_id, json_transform(body, {_SHAPE}) AS r FROM (SELECT DISTINCT run_id, case_id, {_BODY} AS body FROM eval_runs WHERE status = 'ok') WHERE json_valid(body))"
_SCHEMA = "summary string, strengths array<string>, major_concerns array<struct<id: string, category: string, problem: string, evidence: array<struct<paragraph_id: string, excerpt: string>>>>, questions array<string>, recommendation struct<verdict: string, confidence: double>, limitations array<string>"


def structured(spark, folder) -> DataFrame:
    """``(run_id, case_id, r)``: the answers that are sound JSON, taken apart."""
    t = table(spark, folder, "eval_runs").filter("status = 'ok'").select("run_id", "case_id", text.json_body(F.col("raw_output")).alias("body")).distinct()
    return t.filter(F.try_parse_json("body").isNotNull()).select("run_id", "case_id", F.from_json("body", _SCHEMA).alias("r"))


def _n(c: str) -> Column:
    return F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("bigint")


def _n_sql(c: str) -> str:
    return f"coalesce(len({c}), 0)"


# What a verdict is worth.
VERDICTS = {"ready_for_submission": 90, "minor_revision": 76, "major_revision": 56, "fundamental_revision": 34, "insufficient_evidence": 24}


@_query(
    "c08_review_scores",
    "SELECT run_id, greatest(0, least(100, CASE r.recommendation.verdict " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in VERDICTS.items()) + f" ELSE 50 END + least(2 * {_n_sql('r.strengths')}, 8) - least(4 * {_n_sql('r.major_concerns')}, 16))) AS score, coalesce(r.recommendation.confidence, 0) AS confidence FROM {_REVIEW_SQL}",
)
def c08(spark, folder):
    """A score for each review from its verdict, strengths and concerns."""
    base = None
    for v, x in VERDICTS.items():
        hit = F.col("r.recommendation.verdict") == v
        base = F.when(hit, x) if base is None else base.when(hit, x)
    score = base.otherwise(50) + F.least(2 * _n("r.strengths"), F.lit(8)) - F.least(4 * _n("r.major_concerns"), F.lit(16))
    return structured(spark, folder).select("run_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), F.coalesce("r.recommendation.confidence", F.lit(0.0)).alias("confidence"))


_PROBLEM = {
    "invalid_recommendation": ("coalesce(r.recommendation.verdict, '') NOT IN (" + ", ".join(f"'{v}'" for v in VERDICTS) + ")", lambda: ~F.coalesce("r.recommendation.verdict", F.lit("")).isin(*VERDICTS)),
    "invalid_summary": ("length(coalesce(r.summary, '')) < 20", lambda: F.length(F.coalesce("r.summary", F.lit(""))) < 20),
    "strengths_not_array": ("r.strengths IS NULL", lambda: F.col("r.strengths").isNull()),
    "questions_not_array": ("r.questions IS NULL", lambda: F.col("r.questions").isNull()),
    "limitations_not_array": ("r.limitations IS NULL", lambda: F.col("r.limitations").isNull()),
    "major_concerns_not_array": ("r.major_concerns IS NULL", lambda: F.col("r.major_concerns").isNull()),
    "incomplete_concern": ("len(list_filter(coalesce(r.major_concerns, []), lambda c: coalesce(c.id, '') = '' OR coalesce(c.category, '') = '' OR coalesce(c.problem, '') = '')) > 0", lambda: F.exists(F.coalesce("r.major_concerns", F.array()), lambda c: F.greatest(*[(F.coalesce(c[x], F.lit("")) == "") for x in ("id", "category", "problem")]))),
    "concern_without_evidence": ("len(list_filter(coalesce(r.major_concerns, []), lambda c: coalesce(len(c.evidence), 0) = 0)) > 0", lambda: F.exists(F.coalesce("r.major_concerns", F.array()), lambda c: F.coalesce(F.size(c["evidence"]) < 1, F.lit(True)))),
}


@_query("k07_contract_errors", "SELECT run_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{k}' END" for k, (sql, _) in _PROBLEM.items()) + f"], lambda x: x IS NOT NULL), '|') AS errors FROM {_REVIEW_SQL}")
def k07(spark, folder):
    """What is wrong with the shape of each review."""
    return structured(spark, folder).select("run_id", F.array_join(F.array(*[F.when(f(), k) for k, (_, f) in _PROBLEM.items()]), "|").alias("errors"))


@_query(
    "p24_features",
    f"SELECT run_id, {_n_sql('r.strengths')} AS strength_count, {_n_sql('r.major_concerns')} AS major_concern_count, {_n_sql('r.questions')} AS question_count, coalesce(r.recommendation.confidence, 0) AS confidence, round(ln(1 + length(coalesce(r.summary, ''))), 6) AS log_summary, " + ", ".join(f"CAST(coalesce(r.recommendation.verdict = '{v}', false) AS INTEGER) AS verdict_{v}" for v in VERDICTS) + ", " + ", ".join(f"len(list_filter(coalesce(r.major_concerns, []), lambda c: c.category = '{c}')) AS major_{c}" for c, _ in text.CATEGORIES) + f" FROM {_REVIEW_SQL}",
)
def p24(spark, folder):
    """Each review as a flat row of numbers."""
    verdict = [F.coalesce(F.col("r.recommendation.verdict") == v, F.lit(False)).cast("int").alias(f"verdict_{v}") for v in VERDICTS]
    of = F.transform(F.coalesce("r.major_concerns", F.array()), lambda x: x["category"])
    category = [F.size(F.filter(of, lambda x: x == F.lit(name))).cast("bigint").alias(f"major_{name}") for name, _ in text.CATEGORIES]  # noqa: B023
    return structured(spark, folder).select("run_id", _n("r.strengths").alias("strength_count"), _n("r.major_concerns").alias("major_concern_count"), _n("r.questions").alias("question_count"), F.coalesce("r.recommendation.confidence", F.lit(0.0)).alias("confidence"), F.round(F.log1p(F.length(F.coalesce("r.summary", F.lit("")))), 6).alias("log_summary"), *verdict, *category)


def _stems_of(x: str) -> str:
    stop = _words(text.ITEM_STOPWORDS)
    return f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}'), lambda w: NOT list_contains({stop}, w)), lambda w: {_stem_sql('w')}), lambda w: NOT list_contains({stop}, w)))"


@_query(
    "j23_question_links",
    f"""WITH q AS (SELECT run_id, n, {_stems_of('q')} AS qs FROM (SELECT run_id, unnest(r.questions) AS q, generate_subscripts(r.questions, 1) AS n FROM {_REVIEW_SQL}) WHERE q IS NOT NULL),
        c AS (SELECT run_id, n, id, {_stems_of("coalesce(p, '')")} AS cs FROM (SELECT run_id, c.id AS id, c.problem AS p, n FROM (SELECT run_id, unnest(r.major_concerns) AS c, generate_subscripts(r.major_concerns, 1) AS n FROM {_REVIEW_SQL})))
        SELECT q.run_id AS run_id, CAST(q.n AS INTEGER) AS question_no, c.id AS concern_id, len(list_intersect(qs, cs)) AS shared FROM q JOIN c ON c.run_id = q.run_id WHERE len(list_intersect(qs, cs)) > 0 QUALIFY row_number() OVER (PARTITION BY q.run_id, q.n ORDER BY len(list_intersect(qs, cs)) DESC, c.n) = 1""",
)
def j23(spark, folder):
    """Each question with the concern it shares most words with, the first of equals; questions that share none have no link."""
    stems = lambda c: F.array_distinct(text.stems(F.coalesce(c, F.lit("")), text.ITEM_STOPWORDS))
    t = structured(spark, folder).select("run_id", "r.questions", F.transform(F.coalesce("r.major_concerns", F.array()), lambda c, i: F.struct(c["id"].alias("id"), stems(c["problem"]).alias("stems"))).alias("cs"))
    q = t.select("run_id", "cs", F.posexplode("questions").alias("no", "q")).filter("q is not null").withColumn("qs", stems(F.col("q")))
    scored = F.transform("cs", lambda c, i: F.struct((-F.size(F.array_intersect(c["stems"], F.col("qs")))).alias("minus"), i.alias("place"), c["id"].alias("id")))
    best = q.select("run_id", (F.col("no") + 1).alias("question_no"), F.array_min(scored).alias("b")).filter("b.minus < 0")
    return best.select("run_id", "question_no", F.col("b.id").alias("concern_id"), (-F.col("b.minus")).cast("bigint").alias("shared"))


_EVIDENCE = f"(SELECT run_id, case_id, e.paragraph_id AS paragraph_id, e.excerpt AS excerpt FROM (SELECT run_id, case_id, unnest(c.evidence) AS e FROM (SELECT run_id, case_id, unnest(r.major_concerns) AS c FROM {_REVIEW_SQL})))"


@_query(
    "m26_evidence",
    rf"SELECT e.run_id AS run_id, count(*) AS checked, count_if(p.case_id IS NOT NULL) AS grounded, count_if(trim(coalesce(e.excerpt, '')) <> '' AND contains(regexp_replace(lower(coalesce(p.text, '')), '\s+', ' ', 'g'), trim(regexp_replace(lower(e.excerpt), '\s+', ' ', 'g')))) AS quoted FROM {_EVIDENCE} e LEFT JOIN (SELECT case_id, paragraph_id, max(text) AS text FROM {_PARAGRAPHS} GROUP BY 1, 2) p ON p.case_id = e.case_id AND p.paragraph_id = e.paragraph_id GROUP BY 1",
)
def m26(spark, folder):
    """How much of each review's evidence names a paragraph of its case, and quotes it."""
    e = structured(spark, folder).select("run_id", "case_id", F.explode("r.major_concerns").alias("c")).select("run_id", "case_id", F.explode("c.evidence").alias("e")).select("run_id", "case_id", "e.paragraph_id", "e.excerpt")
    p = _paragraphs(spark, folder).groupBy("case_id", "paragraph_id").agg(F.max("text").alias("text"), F.lit(1).alias("there"))
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    quoted = (F.trim(F.coalesce("excerpt", F.lit(""))) != "") & F.contains(plain(F.coalesce("text", F.lit(""))), F.trim(plain(F.col("excerpt"))))
    return e.join(p, ["case_id", "paragraph_id"], "left").groupBy("run_id").agg(F.count("*").alias("checked"), F.count("there").alias("grounded"), F.count_if(quoted).alias("quoted"))


# ---- rankings and pairs compared ----


@_query(
    "m10_grouped_accuracy",
    f"""WITH k AS (SELECT venue, round(rating) AS t, floor(mock * 2) AS s FROM {PAPERS_SQL} WHERE rating IS NOT NULL)
        SELECT count(*) AS pairs, round(count_if(sign(x.s - y.s) = sign(x.t - y.t)) / count(*), 6) AS continuous, round((count_if(sign(x.s - y.s) = sign(x.t - y.t)) + count_if(x.s = y.s) / 2) / count(*), 6) AS tie_half FROM k x JOIN k y ON x.venue IS NOT DISTINCT FROM y.venue AND x.t < y.t""",
)
def m10(spark, folder):
    """Pairs of one venue that coarse scores order as the ratings do: a tie counts nothing, or a half."""
    k = papers(spark, folder).filter("rating is not null").select("venue", F.round("rating").alias("t"), F.floor(F.col("mock") * 2).alias("s"))
    sums = metrics.concordance(k, ["venue"], "t", "s").agg(F.sum("pairs").alias("pairs"), F.sum("right").alias("r"), F.sum("ties").alias("ties"))
    return sums.select("pairs", F.round(ratio(F.col("r"), F.col("pairs")), 6).alias("continuous"), F.round(ratio(F.col("r") + F.col("ties") / 2, F.col("pairs")), 6).alias("tie_half"))


_BATCH_PAIRS = f"(SELECT x.b AS b, x.r1 AS r1, y.r1 AS r1y, x.r2 AS r2, y.r2 AS r2y, x.item AS item, y.item AS itemy FROM {_BATCHED} x JOIN {_BATCHED} y ON x.b = y.b AND x.r1 < y.r1)"


def _batch_pairs(spark, folder) -> DataFrame:
    """The pairs of each batch (of four) in the order of the first ranking."""
    one, two = _rankings(spark, folder)
    t = one.withColumnRenamed("rank", "r1").join(two.withColumnRenamed("rank", "r2"), ["batch", "item"])
    other = t.select("batch", F.col("r1").alias("r1y"), F.col("r2").alias("r2y"), F.col("item").alias("itemy"))
    return t.join(other, "batch").filter("r1 < r1y")


@_query("m18_listwise", f"SELECT count(*) AS pairs, count_if(item % 5 <> itemy % 5) AS target_pairs, round(count_if(item % 5 > itemy % 5) / count_if(item % 5 <> itemy % 5), 6) AS accuracy, round(count_if(sign(r2y - r2) = sign(item % 5 - itemy % 5) AND item % 5 <> itemy % 5) / count_if(item % 5 <> itemy % 5), 6) AS baseline_accuracy, round(count_if(r2 <= r2y) / count(*), 6) AS agreement FROM {_BATCH_PAIRS}")
def m18(spark, folder):
    """A ranking of batches against a target and against another ranking; ties agree."""
    x, y = F.col("item") % 5, F.col("itemy") % 5
    other = F.count_if(x != y)
    return _batch_pairs(spark, folder).agg(F.count("*").alias("pairs"), other.alias("target_pairs"), F.round(ratio(F.count_if(x > y), other), 6).alias("accuracy"), F.round(ratio(F.count_if((F.signum(F.col("r2y") - F.col("r2")) == F.signum(x - y)) & (x != y)), other), 6).alias("baseline_accuracy"), F.round(F.count_if(F.col("r2") <= F.col("r2y")) / F.count("*"), 6).alias("agreement"))


@_query("r01_borda_pairs", f"SELECT count(*) AS pairs, count_if(d = 0) AS ties, round(count_if(d <> 0) / count(*), 6) AS coverage, round(count_if(d <> 0 AND sign(d) = sign(itemy - item)) / count_if(d <> 0), 6) AS accuracy, round((count_if(d <> 0 AND sign(d) = sign(itemy - item)) + count_if(d = 0) / 2) / count(*), 6) AS tie_half FROM (SELECT *, r1y + r2y - r1 - r2 AS d FROM {_BATCH_PAIRS})")
def r01p(spark, folder):
    """The order by rank sums of two runs against the order of the keys; equal sums are ties."""
    d, right = F.col("r1y") + F.col("r2y") - F.col("r1") - F.col("r2"), F.signum(F.col("itemy") - F.col("item"))
    t = _batch_pairs(spark, folder).select(d.alias("d"), (F.signum(d) == right).alias("right"))
    ties, good = F.count_if(F.col("d") == 0), F.count_if((F.col("d") != 0) & F.col("right"))
    return t.agg(F.count("*").alias("pairs"), ties.alias("ties"), F.round((F.count("*") - ties) / F.count("*"), 6).alias("coverage"), F.round(ratio(good, F.count("*") - ties), 6).alias("accuracy"), F.round((good + ties / 2) / F.count("*"), 6).alias("tie_half"))


@_query("r02_borda_table", f"SELECT b AS batch, item, r1 + r2 AS rank_sum, row_number() OVER (PARTITION BY b ORDER BY r1 + r2, item) AS place FROM {_BATCHED}")
def r02(spark, folder):
    """Each batch in the order of its rank sums."""
    one, two = _rankings(spark, folder)
    return fusion.borda(one, two, "batch", "item", "rank").withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("rank_sum", "item")).cast("bigint"))


@_query("w08_reranked", "SELECT b, s_suppkey, row_number() OVER (PARTITION BY b ORDER BY floor(s_acctbal / 1000) DESC, rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s_name DESC) AS rank FROM (SELECT *, CAST(floor((s_suppkey - 1) / 4) AS BIGINT) AS b FROM supplier WHERE s_acctbal >= 0))")
def w08(spark, folder):
    """Ranks within batches after invalid rows are dropped, made anew by score, ties by the rank before."""
    t = table(spark, folder, "supplier").filter("s_acctbal >= 0").withColumn("b", F.floor((F.col("s_suppkey") - 1) / 4))
    w = Window.partitionBy("b")
    ranked = t.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s_name"))))
    return ranked.select("b", "s_suppkey", F.row_number().over(w.orderBy(F.floor(F.col("s_acctbal") / 1000).desc(), "rank")).cast("bigint").alias("new_rank"))


@_query("o02_best_hits", f"SELECT item, hits, round(rrf, 6) AS rrf, relevance FROM (SELECT item, count(*) AS hits, sum(1 / (rank + 1.0)) AS rrf, max(relevance) AS relevance FROM {_HITS} GROUP BY 1) ORDER BY hits DESC, round(rrf, 9) DESC, relevance DESC, item LIMIT 25")
def o02(spark, folder):
    """The 25 best fused items: by hits, reciprocal ranks, relevance and key."""
    t = group_row_number(table(spark, folder, "events").select("event_id", "event_type", "user_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")])
    hits = t.select(F.col("user_id").alias("item"), F.col("event_type").alias("query"), (F.col("row_number") - 1).alias("rank"), F.col("value").alias("relevance"))
    best = fusion.reciprocal_rank_fusion(hits, "item", "query", "rank", "relevance").orderBy(F.desc("hits"), F.round("rrf", 9).desc(), F.desc("relevance"), "item").limit(25)
    return best.select("item", "hits", F.round("rrf", 6).alias("rrf"), "relevance")


@_query("o11_capped_pairs", "SELECT pair_id, rank FROM (SELECT pair_id, row_number() OVER (ORDER BY sha256('42|' || pair_id), pair_id) AS rank FROM pairs WHERE pair_id IS NOT NULL AND abs(rts_gap) >= 0.5) WHERE rank <= 200")
def o11(spark, folder):
    """A reproducible sample of 200 pairs with some gap."""
    t = table(spark, folder, "pairs").filter("pair_id is not null and abs(rts_gap) >= 0.5").select("pair_id", F.sha2(F.concat(F.lit("42|"), "pair_id"), 256).alias("h"))
    return t.orderBy("h", "pair_id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy("h", "pair_id")).cast("bigint")).select("pair_id", "rank")


@_query("o07_interleaved", f"SELECT paper_id, row_number() OVER (ORDER BY pos, label) AS place FROM (SELECT paper_id, label, row_number() OVER (PARTITION BY label ORDER BY paper_id) AS pos FROM {PAPERS_SQL} WHERE label IS NOT NULL)")
def o07(spark, folder):
    """Rejected and accepted papers in turn."""
    t = group_row_number(papers(spark, folder).filter("label is not null").select("paper_id", "label"), ["label"], [F.col("paper_id")], "pos")
    return global_row_number(t, [F.col("pos"), F.col("label")], "place").select("paper_id", "place")


@_query("l05_positional_split", "SELECT paper_id, CASE WHEN n <= floor(0.9 * total) THEN 'train' ELSE 'validation' END AS split FROM (SELECT paper_id, row_number() OVER (ORDER BY sha256('42|' || paper_id), paper_id) AS n, count(*) OVER () AS total FROM proreview)")
def l05(spark, folder):
    """The first nine tenths in hash order train, the rest validate."""
    t = global_row_number(table(spark, folder, "proreview").select("paper_id"), [F.sha2(F.concat(F.lit("42|"), "paper_id"), 256), F.col("paper_id")], "n")
    total = t.agg(F.count("*").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("paper_id", F.when(F.col("n") <= F.floor(F.col("total") * 0.9), "train").otherwise("validation").alias("split"))


@_query("l07_pair_labels", f"SELECT pair_id, CASE WHEN delta > 0 THEN 1 ELSE 0 END AS label, CASE WHEN delta > 0 THEN 'A' ELSE 'B' END AS expected FROM {_PAIRS_SQL} WHERE abs(delta) >= 1")
def l07(spark, folder):
    """Which side of a pair is rated higher, for pairs a level apart."""
    p = papers(spark, folder).filter("rating is not null").select("paper_id", "rating")
    t = table(spark, folder, "pairs").join(p.select(F.col("paper_id").alias("a_id"), F.col("rating").alias("x")), "a_id").join(p.select(F.col("paper_id").alias("b_id"), F.col("rating").alias("y")), "b_id")
    return t.filter(F.abs(F.col("x") - F.col("y")) >= 1).select("pair_id", (F.col("x") > F.col("y")).cast("int").alias("label"), F.when(F.col("x") > F.col("y"), "A").otherwise("B").alias("expected"))


@_query("l09_both_orientations", f"SELECT pair_id, a_id, b_id, said, 'given' AS orientation FROM pairs JOIN {_SAID_SQL} USING (pair_id) UNION ALL SELECT pair_id, b_id, a_id, CASE said WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE said END, 'swapped' FROM pairs JOIN {_SAID_SQL} USING (pair_id)")
def l09(spark, folder):
    """Each verdict as given, and with sides and winner exchanged."""
    t = table(spark, folder, "pairs").join(verdicts(spark, folder), "pair_id").select("pair_id", "a_id", "b_id", "said")
    turned = F.when(F.col("said") == "A", "B").when(F.col("said") == "B", "A").otherwise(F.col("said"))
    swapped = t.select("pair_id", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), turned.alias("said"), F.lit("swapped").alias("orientation"))
    return t.withColumn("orientation", F.lit("given")).unionByName(swapped)


@_query("j06_two_orientations", f"WITH v AS (SELECT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y, a_id < b_id AS straight, CASE WHEN said = 'tie' THEN 'tie' WHEN (said = 'A') = (a_id < b_id) THEN 'x' ELSE 'y' END AS won FROM pairs JOIN {_SAID_SQL} USING (pair_id) WHERE said IS NOT NULL AND a_id <> b_id), g AS (SELECT x, y, straight, CASE WHEN count(DISTINCT won) = 1 THEN min(won) ELSE 'tie' END AS won FROM v GROUP BY 1, 2, 3) SELECT o.x AS x, o.y AS y, CASE WHEN o.won = s.won THEN o.won ELSE 'tie' END AS won, o.won = s.won AS consistent FROM g o JOIN g s ON o.x = s.x AND o.y = s.y AND o.straight AND NOT s.straight")
def j06(spark, folder):
    """Couples judged in both orders: one verdict, a tie where the orders disagree."""
    t = table(spark, folder, "pairs").filter("a_id <> b_id").join(verdicts(spark, folder).filter("said is not null"), "pair_id")
    won = F.when(F.col("said") == "tie", "tie").when((F.col("said") == "A") == (F.col("a_id") < F.col("b_id")), "x").otherwise("y")
    v = t.select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"), (F.col("a_id") < F.col("b_id")).alias("straight"), won.alias("won"))
    g = v.groupBy("x", "y").agg(*[f(F.when(F.col("straight") == s, F.col("won"))).alias(f"{n}_{m}") for s, n in ((True, "o"), (False, "s")) for f, m in ((F.min, "min"), (F.max, "max"))]).dropna(subset=["o_min", "s_min"])
    one = lambda n: F.when(F.col(f"{n}_min") == F.col(f"{n}_max"), F.col(f"{n}_min")).otherwise("tie")
    return g.select("x", "y", F.when(one("o") == one("s"), one("o")).otherwise("tie").alias("won"), (one("o") == one("s")).alias("consistent"))


@_query("j07_completeness", f"SELECT c.case_id AS case_id, coalesce(n, 0) AS answers, coalesce(ok, 0) AS sound, coalesce(ok, 0) > 0 AS complete FROM (SELECT DISTINCT case_id FROM cases WHERE case_id IS NOT NULL) c LEFT JOIN (SELECT case_id, count(DISTINCT run_id) AS n, count(DISTINCT CASE WHEN status = 'ok' THEN run_id END) AS ok FROM eval_runs GROUP BY 1) r ON r.case_id = c.case_id")
def j07(spark, folder):
    """Cases with their answers, those without any at zero."""
    c = table(spark, folder, "cases").filter("case_id is not null").select("case_id").distinct()
    r = table(spark, folder, "eval_runs").groupBy("case_id").agg(F.count_distinct("run_id").alias("answers"), F.count_distinct(F.when(F.col("status") == "ok", F.col("run_id"))).alias("sound"))
    return c.join(r, "case_id", "left").na.fill(0, ["answers", "sound"]).withColumn("complete", F.col("sound") > 0)


@_query("a31_retrieval", "SELECT venue, count(*) AS requested, count_if(length(markdown.content) > 0) AS retrieved, count_if(length(markdown.content) >= 1000 AND trim(title) <> '') AS usable FROM (SELECT p.markdown, p.title, x.venue FROM proreview p JOIN " + PAPERS_SQL + " x USING (paper_id)) GROUP BY 1")
def a31(spark, folder):
    """Papers asked for, at hand and usable by venue."""
    t = _markdown(spark, folder).join(papers(spark, folder).select("paper_id", "venue"), "paper_id")
    n = F.length("content")
    return t.groupBy("venue").agg(F.count("*").alias("requested"), F.count_if(n > 0).alias("retrieved"), F.count_if((n >= 1000) & (F.trim("title") != "")).alias("usable"))


_Q = "list_sort(list(latency_ms))"


@_query(
    "m28_six_percentiles",
    f"""SELECT model, n, round(quantile, 6) AS linear, CASE WHEN floor((n - 1) * 0.95) = ceil((n - 1) * 0.95) THEN quantile ELSE floor(quantile + 0.5) END AS rounded_between, floor(quantile * 10 + 0.5) / 10 AS one_digit, v[greatest(ceil(n * 0.95) - 1, 0)::BIGINT + 1]::DOUBLE AS nearest_rank, v[least(floor(n * 0.95), n - 1)::BIGINT + 1]::DOUBLE AS truncated, v[floor((n - 1) * 0.95 + 0.5)::BIGINT + 1]::DOUBLE AS rounded_place
        FROM (SELECT model, count(latency_ms) AS n, quantile_cont(latency_ms::DOUBLE, 0.95) AS quantile, list_sort(list(latency_ms)) AS v FROM eval_runs WHERE latency_ms IS NOT NULL GROUP BY 1)""",
)
def m28six(spark, folder):
    """The 95th percentile of latency by six definitions."""
    t = quantiles(table(spark, folder, "eval_runs"), ["model"], "latency_ms", {"linear": (0.95, "linear"), "nearest_rank": (0.95, "nearest_rank"), "truncated": (0.95, "truncated"), "rounded_place": (0.95, "rounded")})
    place = (F.col("n") - 1) * 0.95
    between = F.when(F.floor(place) == F.ceil(place), F.col("linear")).otherwise(F.floor(F.col("linear") + 0.5).cast("double"))
    return t.select("model", "n", F.round("linear", 6).alias("linear"), between.alias("rounded_between"), (F.floor(F.col("linear") * 10 + 0.5) / 10).alias("one_digit"), "nearest_rank", "truncated", "rounded_place")


@_query("m29_quartiles", f"SELECT x.paper_id AS paper_id, round(x.mock - b.p50, 6) AS delta, CASE WHEN b.n IS NULL OR b.n < 2 THEN 'insufficient' WHEN x.mock >= b.p75 THEN 'top' WHEN x.mock >= b.p25 THEN 'middle' ELSE 'low' END AS quartile FROM {PAPERS_SQL} x LEFT JOIN (SELECT venue, count(*) AS n, quantile_cont(mock, 0.25) AS p25, quantile_cont(mock, 0.5) AS p50, quantile_cont(mock, 0.75) AS p75 FROM {PAPERS_SQL} WHERE label = 1 GROUP BY 1) b ON b.venue = x.venue")
def m29q(spark, folder):
    """Each paper among the quartiles of its venue's accepted papers."""
    p = papers(spark, folder).select("paper_id", "venue", "label", "mock")
    b = quantiles(p.filter("label = 1"), ["venue"], "mock", {"p25": (0.25, "linear"), "p50": (0.5, "linear"), "p75": (0.75, "linear")})
    verdict = F.when(F.col("n").isNull() | (F.col("n") < 2), "insufficient").when(F.col("mock") >= F.col("p75"), "top").when(F.col("mock") >= F.col("p25"), "middle").otherwise("low")
    return p.join(b, "venue", "left").select("paper_id", F.round(F.col("mock") - F.col("p50"), 6).alias("delta"), verdict.alias("quartile"))


_GROUPS = f"(SELECT doc_kind, sha256(lower(trim(text))) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"


@_query("d05_group_digests", f"SELECT doc_kind, count(*) AS texts, CAST(sum(n) AS BIGINT) AS copies, substr(sha256(count(*) || '|' || min(h) || '|' || max(h) || '|' || CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR)), 1, 16) AS digest FROM {_GROUPS} GROUP BY 1")
def d05(spark, folder):
    """A digest of each group's members, whatever their order, that no group is gathered for."""
    t = table(spark, folder, "documents").filter("text is not null").groupBy("doc_kind", F.sha2(F.lower(F.trim("text")), 256).alias("h")).agg(F.count("*").alias("n"))
    return t.groupBy("doc_kind").agg(F.count("*").alias("texts"), F.sum("n").alias("copies"), hashing.set_digest(F.col("h")).alias("digest"))


# ---- lookups, tables of runs, and scores ----


@_query("j11_strict_lookup", "SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def j11(spark, folder):
    """Suppliers with their nations; a nation that isn't there would be an error."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return validation.strict_lookup(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey").select("s_suppkey", "nation")


@_query("j03_readable_papers", f"SELECT x.paper_id AS paper_id, x.mock AS mock FROM {PAPERS_SQL} x JOIN proreview p USING (paper_id) WHERE trim(p.title) <> '' AND trim(p.markdown.content) <> ''")
def j03(spark, folder):
    """Scores of the papers that have a title and a text."""
    there = _markdown(spark, folder).filter("trim(title) <> '' and trim(content) <> ''").select("paper_id")
    return papers(spark, folder).select("paper_id", "mock").join(there, "paper_id")


@_query("r04_consistent_couples", f"{ORACLE['j06_two_orientations'].rsplit(' FROM g o', 1)[0].rsplit('SELECT', 1)[0]} SELECT o.x AS x, o.y AS y, o.won AS won FROM g o JOIN g s ON o.x = s.x AND o.y = s.y AND o.straight AND NOT s.straight WHERE o.won = s.won AND o.won <> 'tie'")
def r04(spark, folder):
    """Couples with the same winner in both orders; a tie is nobody's win."""
    return j06(spark, folder).filter("consistent and won <> 'tie'").select("x", "y", "won")


_RUNS = "(SELECT model, count_if(status = 'ok') / count(*) AS ok, count_if(schema_valid) / count(*) AS valid FROM eval_runs GROUP BY 1)"


@_query("m24_margins", f"WITH r AS {_RUNS}, b AS (SELECT * FROM r ORDER BY model LIMIT 1) SELECT r.model AS model, round(r.ok, 6) AS ok, round(r.valid, 6) AS valid, r.ok >= b.ok - 0.02 AS ok_held, r.valid >= b.valid - 0.03 AS valid_held, r.ok >= b.ok - 0.02 AND r.valid >= b.valid - 0.03 AS all_held FROM r, b")
def m24(spark, folder):
    """Each model against the first by two shares with a margin each."""
    r = table(spark, folder, "eval_runs").groupBy("model").agg((F.count_if(F.col("status") == "ok") / F.count("*")).alias("ok"), (F.count_if("schema_valid") / F.count("*")).alias("valid"))
    b = r.orderBy("model").limit(1).select(F.col("ok").alias("b_ok"), F.col("valid").alias("b_valid"))
    held = [(F.col("ok") >= F.col("b_ok") - 0.02).alias("ok_held"), (F.col("valid") >= F.col("b_valid") - 0.03).alias("valid_held")]
    return r.crossJoin(F.broadcast(b)).select("model", F.round("ok", 6).alias("ok"), F.round("valid", 6).alias("valid"), *held).withColumn("all_held", F.col("ok_held") & F.col("valid_held"))


@_query("c05_tiers", f"SELECT venue, CASE WHEN support >= 100 AND n >= 200 AND e <= 0.05 THEN 'high' WHEN support >= 30 AND n >= 50 AND e <= 0.12 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT venue, count(*) AS support, count(label) AS n, abs(avg(CASE WHEN label IS NOT NULL THEN 1 / (1 + exp(-mock)) END) - avg(label)) AS e FROM {PAPERS_SQL} GROUP BY 1)")
def c05(spark, folder):
    """How far each venue's calibration can be relied on."""
    p = F.when(F.col("label").isNotNull(), sigmoid(F.col("mock")))
    t = papers(spark, folder).groupBy("venue").agg(F.count("*").alias("support"), F.count("label").alias("n"), F.abs(F.avg(p) - F.avg("label")).alias("e"))
    return t.select("venue", calibration.confidence_tier(F.col("support"), F.col("n"), F.col("e")).alias("tier"))


@_query("c07_reference_scores", f"SELECT round(mock, 8) AS score, row_number() OVER (ORDER BY round(mock, 8), paper_id) AS place FROM {PAPERS_SQL} WHERE year <= 2024")
def c07(spark, folder):
    """The sorted scores that others are calibrated by."""
    t = papers(spark, folder).filter("year <= 2024").select("paper_id", F.round("mock", 8).alias("score"))
    return global_row_number(t, [F.col("score"), F.col("paper_id")], "place").select("score", "place")


@_query("f51_roundings", "SELECT s_suppkey, CAST(floor(x + 0.5) AS BIGINT) AS half_up, CAST(CASE WHEN x = floor(x) + 0.5 THEN floor(x) + floor(x) % 2 ELSE floor(x + 0.5) END AS BIGINT) AS half_even, CAST(trunc(x) AS BIGINT) AS cut FROM (SELECT s_suppkey, s_suppkey / 2 AS x FROM supplier)")
def f51(spark, folder):
    """Halves rounded up, to even, and cut off."""
    x = F.col("s_suppkey") / 2
    return table(spark, folder, "supplier").select("s_suppkey", F.floor(x + 0.5).alias("half_up"), F.bround(x, 0).cast("bigint").alias("half_even"), x.cast("bigint").alias("cut"))


@_query("f57_recency", f"SELECT paper_id, greatest(0, 20 - 4 * (2026 - year)) AS recency, year >= 2026 - 3 AS in_window FROM {PAPERS_SQL}")
def f57(spark, folder):
    """What a year is worth, and whether it lies in a window, as of a given year; null for none."""
    age = F.lit(2026) - F.col("year")
    return papers(spark, folder).select("paper_id", F.when(F.col("year").isNotNull(), F.greatest(F.lit(0), 20 - 4 * age)).otherwise(0).alias("recency"), (age <= 3).alias("in_window"))


@_query("p26_variants", "SELECT paper_id, variant, CASE variant WHEN 'title' THEN coalesce(title, '') ELSE coalesce(title, '') || chr(10) || chr(10) || coalesce(markdown.content, '') END AS input FROM proreview, (VALUES ('title'), ('fulltext')) v(variant)")
def p26(spark, folder):
    """Two inputs per paper, by the name of the variant."""
    title, content = (F.coalesce(c, F.lit("")) for c in ("title", "content"))
    both = F.array(F.struct(F.lit("title").alias("variant"), title.alias("input")), F.struct(F.lit("fulltext").alias("variant"), F.concat(title, F.lit("\n\n"), content).alias("input")))
    return _markdown(spark, folder).select("paper_id", F.explode(both).alias("v")).select("paper_id", "v.*")


@_query("o20_resolved_names", f"SELECT paper_id, CASE WHEN score >= 75 THEN said END AS resolved, score FROM (SELECT paper_id, said, {_MATCH} AS score, row_number() OVER (PARTITION BY paper_id ORDER BY {_MATCH} DESC, no) AS rn FROM (SELECT paper_id, said, no, {_key_sql('said')} AS a, {_key_sql('venue')} AS b, '' AS c FROM (SELECT x.paper_id, x.venue, unnest([p.metadata.venue, {_LAST.replace('metadata', 'p.metadata')}]) AS said, unnest([1, 2]) AS no FROM proreview p JOIN {PAPERS_SQL} x USING (paper_id)))) WHERE rn = 1")
def o20(spark, folder):
    """Of the names a paper gives its venue the one that fits best, the first of equals; none below 75."""
    t = table(spark, folder, "proreview").select("paper_id", F.array("metadata.venue", F.regexp_replace("metadata.venueid", "^.*/", "")).alias("names")).join(papers(spark, folder).select("paper_id", "venue"), "paper_id")
    scored = F.transform("names", lambda n, i: F.struct((-text.name_match(n, F.col("venue"), F.lit(""))).alias("minus"), i.alias("no"), n.alias("said")))
    best = t.select("paper_id", F.array_min(scored).alias("b"))
    return best.select("paper_id", F.when(F.col("b.minus") <= -75, F.col("b.said")).alias("resolved"), (-F.col("b.minus")).alias("score"))


@_query("c10_factors", f"SELECT run_id, array_to_string(list_filter(list_slice(coalesce(r.strengths, []), 1, 3), lambda x: trim(coalesce(x, '')) <> ''), ' | ') AS positive, array_to_string(list_filter(list_transform(list_slice(coalesce(r.major_concerns, []), 1, 4), lambda c: trim(coalesce(c.problem, ''))), lambda x: x <> ''), ' | ') AS risks FROM {_REVIEW_SQL}")
def c10(spark, folder):
    """The first strengths and concerns of each review as reasons for its score."""
    positive = F.filter(F.slice(F.coalesce("r.strengths", F.array().cast("array<string>")), 1, 3), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    problems = F.transform(F.coalesce("r.major_concerns", F.array()), lambda c: F.trim(F.coalesce(c["problem"], F.lit(""))))
    return structured(spark, folder).select("run_id", F.array_join(positive, " | ").alias("positive"), F.array_join(F.filter(F.slice(problems, 1, 4), lambda x: x != ""), " | ").alias("risks"))
