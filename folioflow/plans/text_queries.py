"""Queries of scalar text, hash and arithmetic functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import hashing, numbers, text
from folioflow.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _project(name: str, source: str, key: str, make: Callable[[], dict[str, Column]], sql: dict[str, str] | None = None, keep: str = "true") -> None:
    """Registers a projection: the key and the made columns of the source's rows for which ``keep`` holds."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, source).filter(keep).select(key, *[c.alias(n) for n, c in make().items()])

    QUERIES[name] = query
    if sql:
        ORACLE[name] = f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, s in sql.items()) + f" FROM {source} WHERE {keep}"


def _g(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def _words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


_NL, _E = "chr(10)", "''"
_CLEAN = "substring(" + _g("{0}", (r"\r", _E), (r"[ \t]+\n", _NL), (r"\n{{3,}}", f"{_NL}||{_NL}"), (r"^\s+|\s+$", _E)) + ", 1, {1})"
_DOCUMENT = _g("{0}", (r"\r\n?", _NL), (r"[\t\x{{a0}}]+", "' '"), (r" +\n", _NL), (r"\n{{3,}}", f"{_NL}||{_NL}"), (r"^\s+|\s+$", _E))
_SQUEEZE = _g("{0}", (r"\x{{ad}}", _E), (r"[\s\x{{a0}}]+", "' '"), ("^ | $", _E))
_CJK = r"len(regexp_extract_all({0}, '[\x{{3400}}-\x{{9fff}}]'))"
_LATIN = "len(regexp_extract_all({0}, '[A-Za-z]'))"

_project("f01_clean_text", "documents", "doc_id", lambda: {"cleaned": text.clean_text(F.col("text"))}, {"cleaned": _CLEAN.format("text", 200000)})
_project("f15_squeeze", "documents", "doc_id", lambda: {"squeezed": text.squeeze(F.col("text"))}, {"squeezed": _SQUEEZE.format("text")})
_project("f17_document_text", "documents", "doc_id", lambda: {"normal": text.document_text(F.col("text"))}, {"normal": _DOCUMENT.format("text")})
_project(
    "f05_redact",
    "documents",
    "doc_id",
    lambda: {"redacted": text.redact(F.col("text"))},
    {
        "redacted": "regexp_replace("
        + _g(_CLEAN.format("text", 200000), (text.EMAIL, "'[REDACTED_EMAIL]'"), (text.PROFILE_LINK, "'[REDACTED_PROFILE]'"), (text.PROFILE_NAME.replace("'", "''"), "'[REDACTED_PROFILE]'"))
        + f", '{text.ORCID}', '\\1[REDACTED_ORCID]\\2', 'g')"
    },
)
_project("f18_word_count", "documents", "doc_id", lambda: {"words": text.word_count(F.col("text"))}, {"words": "len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) + " + _CJK.format("text")})
_project(
    "f19_language",
    "documents",
    "doc_id",
    lambda: {"by_letters": text.document_language(F.col("text")), "by_length": text.text_language(F.col("text"))},
    {
        "by_letters": f"CASE WHEN {_CJK.format('text')} >= {_LATIN.format('text')} * 0.35 THEN 'zh' ELSE 'en' END",
        "by_length": f"CASE WHEN {_CJK.format('text')} > length(text) * 0.1 THEN 'zh-CN' ELSE 'en' END",
    },
    "text is not null",
)
_project("t12_section_flags", "documents", "doc_id", lambda: {f"has_{n}": F.col("text").rlike(p) for n, p in text.SECTIONS.items()}, {f"has_{n}": f"regexp_matches(text, '{p}')" for n, p in text.SECTIONS.items()})
_project(
    "f34_head_and_tail",
    "documents",
    "doc_id",
    lambda: {"short": text.head_and_tail(F.col("text"), 400)},
    {"short": "CASE WHEN length(text) > 400 THEN substring(text, 1, 200) || chr(10) || '[...]' || chr(10) || right(text, 200) ELSE text END"},
)
_TERMS = f"list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: length(w) > 1 AND NOT list_contains({_words(text.STOPWORDS)}, w))"
_project(
    "f24_terms",
    "documents",
    "doc_id",
    lambda: {"terms": F.size(text.terms(F.col("text"))), "distinct_terms": F.size(F.array_distinct(text.terms(F.col("text"))))},
    {"terms": f"len({_TERMS.format('text')})", "distinct_terms": f"len(list_distinct({_TERMS.format('text')}))"},
    "text is not null",
)
_project(
    "f40_hashes",
    "documents",
    "doc_id",
    lambda: {
        "digest": hashing.sha256(F.col("text")),
        "unit": F.round(hashing.stable_unit(F.col("doc_id").cast("string"), "42"), 9),
        "parity_unit": F.round(hashing.stable_unit(F.col("doc_id").cast("string"), "42", parity=True), 9),
        "ratio": F.round(hashing.ratio_unit(F.col("doc_id").cast("string"), "42"), 9),
        "coin": hashing.coin(F.col("doc_id").cast("string"), "42"),
        "score": hashing.mock_score(F.col("doc_id").cast("string")),
        "id": hashing.short_id(F.col("doc_id").cast("string"), "paper-", 16),
    },
    {
        "digest": "sha256(text)",
        "unit": "round(('0x' || substr(sha256('42' || chr(0) || doc_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496, 9)",
        "parity_unit": "round(('0x' || substr(sha256('42' || chr(0) || doc_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 9007199254740991, 9)",
        "ratio": "round(('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616, 9)",
        "coin": "CAST(('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 2))::UBIGINT % 2 AS INTEGER)",
        "score": "round(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967295 * 8 - 4, 6)",
        "id": "'paper-' || substr(sha256(doc_id::VARCHAR), 1, 16)",
    },
)
_TITLE_TOKENS = f"list_filter(string_split({_g('lower({0})', ('[^{P}]+', chr(39) + ' ' + chr(39)), ('^ | $', _E))}, ' '), lambda w: w <> '' AND NOT list_contains({_words(text.TITLE_WORDS)}, w))".replace("{P}", r"\p{{L}}\p{{N}}")
_project(
    "f04_title_key",
    "cases",
    "case_id",
    lambda: {"title_key": text.title_key(F.col("manuscript.title")), "tokens": F.size(F.array_distinct(text.title_tokens(F.col("manuscript.title")))), "key_hash": hashing.sha256(text.title_key(F.col("manuscript.title")))},
    {
        "title_key": f"array_to_string({_TITLE_TOKENS.format('manuscript.title')}, ' ')",
        "tokens": f"len(list_distinct({_TITLE_TOKENS.format('manuscript.title')}))",
        "key_hash": f"sha256(array_to_string({_TITLE_TOKENS.format('manuscript.title')}, ' '))",
    },
    "manuscript.title is not null",
)
_project(
    "f13_names",
    "cases",
    "case_id",
    lambda: {"name_key": text.name_key(F.col("manuscript.title")), "identity_key": text.identity_key(F.col("manuscript.title")), "slug": text.slug(F.col("manuscript.title")), "html": text.decode_html(F.col("manuscript.title"))},
    {
        "name_key": _g("lower(manuscript.title)", ("&", "'and'"), (r"[^a-z0-9\x{3400}-\x{9fff}]+", "' '"), ("^ | $", _E)),
        "identity_key": _g("lower(manuscript.title)", ("[^a-z0-9]+", _E)),
        "slug": "CASE WHEN "
        + _g("lower(manuscript.title)", ("&", "' and '"), ("[^a-z0-9]+", "'-'"), ("^-+|-+$", _E))
        + " = '' THEN substr(sha256(manuscript.title), 1, 12) ELSE "
        + _g("lower(manuscript.title)", ("&", "' and '"), ("[^a-z0-9]+", "'-'"), ("^-+|-+$", _E))
        + " END",
        "html": _SQUEEZE.format("replace(replace(replace(replace(replace(replace(regexp_replace(manuscript.title, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"),
    },
)
_project(
    "f10_venue",
    "cases",
    "case_id",
    lambda: {"year": text.year_of_venue(F.col("source.venue_id")), "venue_group": text.venue_group(F.col("source.venue_id")), "last_step": F.element_at(F.split(F.col("source.venue_id"), "/"), -1)},
    {
        "year": "CAST(nullif(regexp_extract(source.venue_id, '(20[0-9]{2})(/|$)', 1), '') AS INTEGER)",
        "venue_group": "regexp_replace(source.venue_id, '(?i)(/Conference)(/.*)?$', '\\1')",
        "last_step": "string_split(source.venue_id, '/')[-1]",
    },
)
_NUMBERS = "list_filter(list_transform(regexp_split_to_array({0}, '[;,|[:space:]]+'), lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL)"
_project("f08_number_list", "proreview", "paper_id", lambda: {"ratings": text.number_list(F.col("scores.rating")), "confidences": text.number_list(F.col("scores.confidence"))}, {"ratings": _NUMBERS.format("scores.rating"), "confidences": _NUMBERS.format("scores.confidence")})
_project("f07_first_number", "review_scores", "review_id", lambda: {"rating": text.first_number(F.col("rating"))}, {"rating": "CAST(nullif(regexp_extract(rating, '-?[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE)"})
_LOW = "lower(coalesce(decision.decision, ''))"
_project(
    "l01_decision_labels",
    "proreview",
    "paper_id",
    lambda: {r: text.decision_label(F.col("decision.decision"), r) for r in ("accept_first", "reject_first", "strict")},
    {
        "accept_first": f"CASE WHEN contains({_LOW}, 'accept') THEN 1 WHEN regexp_matches({_LOW}, 'reject|withdraw|decline') THEN 0 END",
        "reject_first": f"CASE WHEN regexp_matches({_LOW}, 'reject|withdraw') THEN 0 WHEN contains({_LOW}, 'accept') THEN 1 ELSE -1 END",
        "strict": f"CASE WHEN contains({_LOW}, 'withdraw') THEN NULL WHEN regexp_matches({_LOW}, 'reject|decline') THEN 0 WHEN regexp_matches({_LOW}, '(^|[^a-z0-9_])accept($|[^a-z0-9_])|poster|spotlight|oral') THEN 1 END",
    },
)
_project(
    "f16_clean_evidence",
    "proreview",
    "paper_id",
    lambda: {"evidence": text.clean_evidence(F.col("markdown.content"))},
    {
        "evidence": _SQUEEZE.format(
            _g(
                "markdown.content",
                (r"(?s)```.*?```", "' '"),
                (r"!\[[^\]]*\]\([^)]*\)", "' '"),
                (r"\[([^\]]+)\]\([^)]*\)", "'\\1'"),
                (r"(?i)https?://\S+|www\.\S+", "' '"),
                (r"\$+[^$]{1,500}\$+|\\(?:cite|ref|label)\{[^}]*\}", "' '"),
                (r"\[(?:\d{1,3}(?:\s*[,;-]\s*\d{1,3})*)\]", "' '"),
                (r"\((?:[A-Z][A-Za-z''`-]+(?:\s+et\s+al\.)?(?:,?\s+\d{4}[a-z]?)(?:\s*;\s*)?)+\)", "' '"),
                (r"(^|[^\w])(?:[A-Z][A-Za-z''`-]+\s+et\s+al\.|[A-Z][A-Za-z''`-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z''`-]+)?)\s*\((?:19|20)\d{2}[a-z]?\)", "'\\1 '"),
                (r"\|[-: |]+\|", "' '"),
                (r"[*_~`]", _E),
            ).replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}")
        ).replace("{{", "{").replace("}}", "}")
    },
)
_FROM = "coalesce(nullif(regexp_extract(markdown.content, '(?is)((?:^|\\n)\\s*(?:参考文献|references?|bibliography)\\s*[:：]?.*)$', 1), ''), markdown.content)"
_project(
    "f21_reference_count",
    "proreview",
    "paper_id",
    lambda: {"references": text.reference_count(F.col("markdown.content"))},
    {"references": f"greatest(len(regexp_extract_all({_FROM}, '(?:^|\\n)\\s*(?:\\[\\d+\\]|\\d+[.)、])\\s+')), least(len(regexp_extract_all({_FROM}, '(?i)\\([12][0-9]{{3}}[a-z]?\\)')), 200))"},
)
_project(
    "f30_sentences",
    "proreview",
    "paper_id",
    lambda: {"sentences": text.sentences(F.col("markdown.content"))},
    {"sentences": "list_filter(list_transform(regexp_split_to_array(regexp_replace(markdown.content, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), '\\x01|\\n+'), lambda s: " + _SQUEEZE.format("s") + "), lambda s: length(s) >= 20)"},
)
_project(
    "f32_prompt",
    "proreview",
    "paper_id",
    lambda: {"prompt": F.format_string("Given a certain paper, Title: %s Abstract: %s", text.squeeze(F.col("title")), F.substring(text.squeeze(F.col("markdown.content")), 1, 300))},
    {"prompt": f"'Given a certain paper, Title: ' || {_SQUEEZE.format('title')} || ' Abstract: ' || substring({_SQUEEZE.format('markdown.content')}, 1, 300)"},
    "title is not null and markdown.content is not null",
)


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "proreview").select("paper_id", F.explode("reviews").alias("r")).select("paper_id", "r.*")


_REVIEWS_SQL = "(SELECT paper_id, r.id AS id, r.initial_rating AS initial_rating, r.confidence AS confidence, r.summary AS summary, r.strengths AS strengths, r.weaknesses AS weaknesses, r.questions AS questions FROM (SELECT paper_id, unnest(reviews) AS r FROM proreview))"


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """What each weakness is about."""
    return _reviews(spark, folder).filter("weaknesses is not null").select("paper_id", F.col("id").alias("review_id"), text.category(F.col("weaknesses")).alias("category"))


QUERIES["f31_category"] = categories
ORACLE["f31_category"] = "SELECT paper_id, id AS review_id, CASE " + " ".join(f"WHEN regexp_matches(lower(weaknesses), '{p}') THEN '{n}'" for n, p in text.CATEGORIES) + f" ELSE 'other' END AS category FROM {_REVIEWS_SQL} WHERE weaknesses IS NOT NULL"


def stem_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """In how many reviews each stem occurs, and how often."""
    rows = _reviews(spark, folder).select("id", F.explode(text.stems(F.concat_ws(" ", "summary", "strengths", "weaknesses", "questions"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("id").alias("reviews"))


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {4 + len(s)} THEN left({w}, length({w}) - {len(s)})" for s in text.SUFFIXES) + f" ELSE {w} END"


QUERIES["f25_stems"] = stem_frequencies
ORACLE["f25_stems"] = f"""SELECT stem, count(*) AS n, count(DISTINCT id) AS reviews FROM (
    SELECT id, unnest(list_filter(list_transform(list_filter(regexp_extract_all(lower(concat_ws(' ', summary, strengths, weaknesses, questions)), '[a-z][a-z0-9-]{{2,}}'),
        lambda w: NOT list_contains({_words(text.STOPWORDS)}, w)), lambda w: {_stem_sql("w")}), lambda w: NOT list_contains({_words(text.STOPWORDS)}, w))) AS stem FROM {_REVIEWS_SQL}) GROUP BY 1"""

_BODY = _g("raw_output", ("(?s)<think>.*?</think>", _E), ("(?i)```(?:json)?", _E))
_project(
    "f59_json_body",
    "eval_runs",
    "run_id",
    lambda: {"body": text.json_body(F.col("raw_output"))},
    {"body": f"CASE WHEN instr({_BODY}, '{{') > 0 AND instr(reverse({_BODY}), '}}') > 0 AND length({_BODY}) - instr(reverse({_BODY}), '}}') + 1 >= instr({_BODY}, '{{') THEN substring({_BODY}, instr({_BODY}, '{{'), length({_BODY}) - instr(reverse({_BODY}), '}}') - instr({_BODY}, '{{') + 2) END"},
)
_project(
    "f59_json_props",
    "events",
    "event_id",
    lambda: {"k": F.get_json_object("props", "$.k").try_cast("int")},
    {"k": "try_cast(json_extract_string(props, '$.k') AS INTEGER)"},
)
_project(
    "f45_numbers",
    "part",
    "p_partkey",
    lambda: {
        "clamped": F.round(numbers.clamp(F.col("p_retailprice") / 100, 0, 12), 6),
        "sigmoid": F.round(numbers.sigmoid((F.col("p_retailprice") - 1000) / 100), 6),
        "log": F.round(F.log1p("p_retailprice"), 6),
        "rounded": numbers.half_up(F.col("p_retailprice"), 1),
        "bucket": numbers.bucket(F.col("p_retailprice"), 250, 6),
        "gap": numbers.gap_class(F.col("p_size") % 5),
        "noise": F.round(numbers.noise_scale(F.col("p_size") / 50), 6),
    },
    {
        "clamped": "round(greatest(0, least(12, p_retailprice / 100)), 6)",
        "sigmoid": "round(1 / (1 + exp(-(p_retailprice - 1000) / 100)), 6)",
        "log": "round(ln(1 + p_retailprice), 6)",
        "rounded": "floor(p_retailprice * 10 + 0.5) / 10",
        "bucket": "CAST(least(floor(abs(p_retailprice) / 250), 5) AS INTEGER)",
        "gap": "CASE p_size % 5 WHEN 1 THEN 'adjacent' WHEN 2 THEN 'moderate' ELSE 'wide' END",
        "noise": "round(0.2 * (1 - p_size / 50) + 0.05, 6)",
    },
)


def inverted(spark: SparkSession, folder: str) -> DataFrame:
    """Each held-out text as an inverted index (word to places) and read back from it."""
    words = table(spark, folder, "heldout_items").select("item_id", F.posexplode(F.split(text.squeeze(F.col("text")), " ")).alias("place", "word"))
    index = words.groupBy("item_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    back = index.select("item_id", "word", F.explode("places").alias("place")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"), F.count_distinct("word").alias("words"))
    return back.select("item_id", "words", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


QUERIES["f58_inverted_index"] = inverted
ORACLE["f58_inverted_index"] = f"SELECT item_id, len(list_distinct(string_split({_SQUEEZE.format('text')}, ' '))) AS words, {_SQUEEZE.format('text')} AS text FROM heldout_items WHERE text IS NOT NULL"


def manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of each case joined by empty lines, and their number."""
    t = table(spark, folder, "cases").select("case_id", "received_at", F.expr("filter(transform(manuscript.paragraphs, x -> x.text), x -> x is not null)").alias("p")).filter("p is not null")
    return t.select("case_id", "received_at", F.substring(F.array_join("p", "\n\n"), 1, 15000).alias("text"), F.size("p").alias("paragraphs"))


QUERIES["f67_manuscript_text"] = manuscripts
ORACLE["f67_manuscript_text"] = "SELECT case_id, received_at, substring(array_to_string(p, chr(10) || chr(10)), 1, 15000) AS text, len(p) AS paragraphs FROM (SELECT case_id, received_at, list_filter(list_transform(manuscript.paragraphs, lambda x: x.text), lambda x: x IS NOT NULL) AS p FROM cases) WHERE p IS NOT NULL"
