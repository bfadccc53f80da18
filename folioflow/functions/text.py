r"""Text as columns: cleaning, keys, redaction, counting, splitting.

All are expressions of built-in functions, so that they stay in generated code, but
for Unicode normal forms (:func:`nfkc`), which Spark has no function for. A null gives
a null, an empty text an empty one, unless said otherwise. ``\b`` means different
things to different regular-expression engines: word edges are spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that title keys leave out.
TITLE_WORDS = "a an the of for with and in on to via".split()
# Words that term lists leave out.
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to using we with".split()
# Suffixes stripped in this order from words of which at least four letters remain.
SUFFIXES = "ization ation ments ment ing ed es s".split()
# What a review remark is about, the first pattern that fits.
CATEGORIES = [
    ("statistical_analysis", "statistic|significan|confidence interval|variance|error bar"),
    ("reproducibility", "reproduc|code|hyperparameter|implementation detail|random seed"),
    ("related_work", "related work|prior work|citation|literature|reference"),
    ("figures_tables", "figure|table|caption|axis|plot"),
    ("writing_clarity", "writing|unclear|readability|presentation|typo|grammar|explain"),
    ("data_quality", "dataset|data quality|sample size|annotation|label"),
    ("experimental_design", "experiment|evaluation|baseline|ablation|benchmark|metric"),
    ("conclusion_support", "conclusion|claim|overclaim|support|evidence"),
    ("methodology", "method|algorithm|objective|assumption|theory|proof|model"),
]
# Headings of the parts of a paper, in English and Chinese.
SECTIONS = {
    "abstract": r"(?i)(^|\n)\s*(摘\s*要|abstract)\s*[:：]?",
    "introduction": r"(?i)(^|\n)\s*(\d+[.、\s]*)?(引言|绪论|introduction|background)\s*[:：]?",
    "methods": r"(?i)(^|\n)\s*(\d+[.、\s]*)?(材料与方法|研究方法|方法|methodology|materials?\s+and\s+methods?|methods?)\s*[:：]?",
    "results": r"(?i)(^|\n)\s*(\d+[.、\s]*)?(结果|实验结果|results?|findings)\s*[:：]?",
    "discussion": r"(?i)(^|\n)\s*(\d+[.、\s]*)?(讨论|分析与讨论|discussion)\s*[:：]?",
    "conclusion": r"(?i)(^|\n)\s*(\d+[.、\s]*)?(结论|总结与展望|conclusions?)\s*[:：]?",
    "references": r"(?i)(^|\n)\s*(参考文献|references?|bibliography)\s*[:：]?",
}
# Authors with a year, as citations have them.
AUTHOR = r"[A-Z][A-Za-z'`-]+"
CITED_AUTHORS = rf"\((?:{AUTHOR}(?:\s+et\s+al\.)?(?:,?\s+\d{{4}}[a-z]?)(?:\s*;\s*)?)+\)"
AUTHOR_YEAR = rf"(^|[^\w])(?:{AUTHOR}\s+et\s+al\.|{AUTHOR}(?:\s+(?:and|&)\s+{AUTHOR})?)\s*\((?:19|20)\d{{2}}[a-z]?\)"
# Words that stems of review items leave out.
ITEM_STOPWORDS = (
    "about after also although among another authors because been before being between both could does from have however into "
    "more most much paper provide results review should some such than that their there these they this through using very "
    "what when where which while with would work method approach unclear missing limited lack needs need please question concern"
).split()
# Single words that say nothing about a scope.
GENERIC_TERMS = "analysis computer data engineering experiment intelligence learning method model science system systems technology".split()
# Titles of surveys.
SURVEYS = r"(?i)(^|[^a-z])(survey|review|overview|bibliometric)([^a-z]|$)|综述"
# What is masked, and how a masked piece reads.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PROFILE_LINK = r"(?i)https?://[a-z0-9.-]+/profile\?id=~?[a-z0-9_.-]+"
PROFILE_NAME = r"~[A-Z][A-Za-z.'-]*_[A-Z][A-Za-z.'_-]*[0-9]+"
ORCID = r"(?i)(^|[^0-9A-Za-z_])[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]($|[^0-9A-Za-z_])"


def _sub(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; text that has it already passes through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean_text(c: Column, most: int | None = 200_000) -> Column:
    """No carriage returns, no blanks at line ends, at most one empty line in a row, cut to ``most`` characters, if given."""
    clean = _sub(c, (r"\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
    return clean if most is None else F.substring(clean, 1, most)


def document_text(c: Column) -> Column:
    """Line ends as line feeds, tabs and hard blanks as blanks, at most one empty line in a row."""
    return _sub(c, (r"\r\n?", "\n"), ("[\t ]+", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))


def squeeze(c: Column) -> Column:
    """No soft hyphens, runs of white space (hard blanks, too) as one blank, trimmed."""
    return _sub(c, ("­", ""), ("[\\s ]+", " "), ("^ | $", ""))


def normalize_license(c: Column) -> Column:
    """A licence name in one spelling."""
    return _sub(F.upper(clean_text(c, 200)), ("CREATIVE COMMONS", "CC"), ("ATTRIBUTION", "BY"), ("INTERNATIONAL", ""), ("[-_]", " "), (r"\s+", " "), ("^ | $", ""))


def title_tokens(c: Column) -> Column:
    """The words of a title key: letters and digits in lower case, without the little words."""
    words = F.split(_sub(F.lower(c), (r"[^\p{L}\p{N}]+", " "), ("^ | $", "")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(TITLE_WORDS))


def title_key(c: Column) -> Column:
    return F.array_join(title_tokens(c), " ")


def terms(c: Column) -> Column:
    """Words of two and more letters or digits in lower case without stop words, repeated ones kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def stems(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """English words of three and more letters without the first suffix that leaves at least four of them, stop words left out before and after."""

    def stem(w: Column) -> Column:
        out = None
        for s in SUFFIXES:
            hit, cut = F.endswith(w, F.lit(s)) & (F.length(w) >= 4 + len(s)), w.substr(F.lit(1), F.length(w) - len(s))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(w)

    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)), lambda w: ~w.isin(stopwords))
    return F.filter(F.transform(words, stem), lambda w: ~w.isin(stopwords))


def name_key(c: Column) -> Column:
    """Lower case, ``&`` as and, Latin letters, digits and Chinese characters in words."""
    return _sub(F.lower(c), ("&", "and"), ("[^a-z0-9㐀-鿿]+", " "), ("^ | $", ""))


def identity_key(c: Column) -> Column:
    """Nothing but Latin letters and digits; empty for a text without any."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slug(c: Column) -> Column:
    """A name for files: everything else as hyphens, a hash where nothing is left."""
    plain = _sub(F.lower(c), ("&", " and "), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
    return F.when(plain == "", F.substring(F.sha2(c, 256), 1, 12)).otherwise(plain)


def redact(c: Column) -> Column:
    """Mail addresses, profile links and names and ORCID numbers masked."""
    masked = _sub(clean_text(c), (EMAIL, "[REDACTED_EMAIL]"), (PROFILE_LINK, "[REDACTED_PROFILE]"), (PROFILE_NAME, "[REDACTED_PROFILE]"))
    return F.regexp_replace(masked, ORCID, "$1[REDACTED_ORCID]$2")


def redact_plain(c: Column) -> Column:
    """Mail addresses, profile links and ORCID numbers under short masks, white space squeezed; empty for null."""
    masked = _sub(F.coalesce(c, F.lit("")), (EMAIL, "[EMAIL]"), (r"(?i)https?://[a-z0-9.-]+/profile\?id=[^\s)]+", "[PROFILE]"), (ORCID, "$1[ORCID]$2"))
    return _sub(masked, (r"\s+", " "), ("^ | $", ""))


def redact_terms(c: Column, names: Column, mask: str = "[REDACTED_AUTHOR]") -> Column:
    """Each of the row's own names of four and more characters masked, whatever its case."""
    quoted = lambda t: F.concat(F.lit("(?i)"), F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    long = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda t: F.length(F.trim(t)) >= 4)
    return F.aggregate(long, c, lambda text, t: F.regexp_replace(text, quoted(F.trim(t)), F.lit(mask)))


def first_number(c: Column) -> Column:
    """The first signed decimal of a text, else null."""
    number = F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0)
    return F.when(number != "", number).cast("double")


def number_list(c: Column) -> Column:
    """The numbers of a list text with any of the usual separators; what is no number is left out. Null for null."""
    return F.filter(F.transform(F.split(c, r"[;,|\s]+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))


def string_list(c: Column, most: int = 100) -> Column:
    """Parts between line ends, semicolons, or commas before a letter, trimmed, without empty ones."""
    parts = F.split(clean_text(c), r"\n|;|；|,(?=\s*[A-Za-z])")
    return F.slice(F.filter(F.transform(parts, lambda x: clean_text(x, 2000)), lambda x: x != ""), 1, most)


def sentences(c: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters: cut after an end mark before a capital or digit, and at line ends."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])|\n+"), squeeze), lambda s: F.length(s) >= least)


def list_items(c: Column, least: int = 8) -> Column:
    """The items of a bulleted or numbered list, else the blocks between empty lines; markers stripped, short ones left out."""
    bulleted = c.rlike(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+")
    parts = F.when(bulleted, F.split(c, r"(?m)(?=^\s*(?:[-*•]|\d+[.)])\s+)")).otherwise(F.split(c, r"\n\s*\n"))
    return F.filter(F.transform(parts, lambda x: squeeze(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))), lambda x: F.length(x) >= least)


def clean_evidence(c: Column) -> Column:
    """Markdown and LaTeX down to plain words: fences, images, links, formulas, citations and emphasis gone."""
    return squeeze(
        _sub(
            c,
            (r"(?s)```.*?```", " "),
            (r"!\[[^\]]*\]\([^)]*\)", " "),
            (r"\[([^\]]+)\]\([^)]*\)", "$1"),
            (r"(?i)https?://\S+|www\.\S+", " "),
            (r"\$+[^$]{1,500}\$+|\\(?:cite|ref|label)\{[^}]*\}", " "),
            (r"\[(?:\d{1,3}(?:\s*[,;-]\s*\d{1,3})*)\]", " "),
            (CITED_AUTHORS, " "),
            (AUTHOR_YEAR, "$1 "),
            (r"\|[-: |]+\|", " "),
            (r"[*_~`]", ""),
        )
    )


def _character(n: Column) -> Column:
    """The character of a code point; a blank for one that is none."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    low = lambda shift: byte(F.shiftright(n, shift).bitwiseAND(63) + 128)
    two = F.concat(byte(F.shiftright(n, 6) + 192), low(0))
    three = F.concat(byte(F.shiftright(n, 12) + 224), low(6), low(0))
    four = F.concat(byte(F.shiftright(n, 18) + 240), low(12), low(6), low(0))
    hexed = F.when(n < 128, byte(n)).when(n < 2048, two).when(n < 65536, three).otherwise(four)
    return F.when((n < 32) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), " ").otherwise(F.decode(F.unhex(hexed), "UTF-8"))


def decode_html(c: Column) -> Column:
    """Tags as blanks, the named entities of markup as characters, squeezed."""
    text, code = _sub(c, ("<[^>]+>", " ")), F.lit(r"&#(\d{1,7});")
    # A decimal entity at a time; each kind is replaced everywhere at once.
    found = F.array_distinct(F.regexp_extract_all(text, code, F.lit(1)))
    text = F.aggregate(found, text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), _character(n.cast("int"))))
    return squeeze(_sub(text, ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")))


def scope_tokens(c: Column) -> Column:
    """Lower-case parts between blanks and any of the list separators, of two and more characters."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s,，;；、/|]+"), lambda w: F.length(w) >= 2)


def scope_text(c: Column) -> Column:
    """Lower case, dashes, underscores and slashes as blanks, squeezed."""
    return _sub(F.lower(F.coalesce(c, F.lit(""))), ("[-–—_/]+", " "), (r"\s+", " "), ("^ | $", ""))


def scope_hits(c: Column, terms_of: list[str], most: int = 8) -> Column:
    """Which of the terms a text names: those of several words or beyond ASCII anywhere, single words of five and more letters as whole words, none that are generic."""
    corpus, wanted = scope_text(c), []
    for t in dict.fromkeys(terms_of):
        plain = " ".join(t.lower().replace("-", " ").replace("_", " ").replace("/", " ").split())
        if " " in plain or not plain.isascii():
            wanted.append(F.when(F.contains(corpus, F.lit(plain)), t))
        elif len(plain) >= 5 and plain not in GENERIC_TERMS:
            wanted.append(F.when(F.array_contains(F.split(corpus, "[^a-z0-9]+"), plain), t))
    return F.slice(F.array_compact(F.array(*wanted)), 1, most) if wanted else F.array().cast("array<string>")


def name_match(candidate: Column, target: Column, other: Column) -> Column:
    """How well a name fits a target: 100 the target or its other name, 80 one within the other, 75 so for the other name, 0; null names count as empty, an empty other name as none."""
    a, b, c = (F.coalesce(name_key(x), F.lit("")) for x in (candidate, target, other))
    within = lambda x, y: F.contains(x, y) | F.contains(y, x)
    return F.when((a == b) | ((c != "") & (a == c)), 100).when(within(a, b), 80).when((c != "") & within(a, c), 75).otherwise(0)


def packed_sentences(c: Column, longer_than: int, most: int) -> Column:
    """A block as it is, or, beyond ``longer_than`` characters, in packs of whole sentences of up to ``most`` characters; a longer sentence is a pack."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a: Column, x: Column) -> Column:
        both = F.trim(F.concat(a["now"], F.lit(" "), x))
        full = (a["now"] != "") & (F.length(both) > most)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), F.when(full, x).otherwise(both).alias("now"))

    packs = F.aggregate(F.split(c, r"(?<=[.!?])\s+"), state, add, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda x: x != ""))
    return F.when(F.length(c) <= longer_than, F.array(c)).otherwise(packs)


def chinese_characters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[㐀-鿿]"))


def word_count(c: Column) -> Column:
    """Latin words and Chinese characters together."""
    return F.regexp_count(c, F.lit("[A-Za-z][A-Za-z'-]*")) + chinese_characters(c)


def document_language(c: Column) -> Column:
    """zh where Chinese characters reach 0.35 of the Latin letters, else en."""
    return F.when(chinese_characters(c) >= F.regexp_count(c, F.lit("[A-Za-z]")) * 0.35, "zh").otherwise("en")


def text_language(c: Column) -> Column:
    """zh-CN where more than a tenth of the characters are Chinese, else en."""
    return F.when(chinese_characters(c) > F.length(c) * 0.1, "zh-CN").otherwise("en")


def reference_count(c: Column) -> Column:
    """Numbered entries or, if more, years in brackets (at most 200), from the heading of the references on, else in the whole text."""
    start = F.regexp_instr(c, F.lit(SECTIONS["references"]))
    part = F.when(start > 0, c.substr(start, F.length(c))).otherwise(c)
    numbered = F.regexp_count(part, F.lit(r"(?:^|\n)\s*(?:\[\d+\]|\d+[.)、])\s+"))
    return F.greatest(numbered, F.least(F.regexp_count(part, F.lit(r"(?i)\([12][0-9]{3}[a-z]?\)")), F.lit(200)))


def section_flags(c: Column) -> list[Column]:
    """Whether each part of a paper has its heading."""
    return [c.rlike(p).alias(f"has_{name}") for name, p in SECTIONS.items()]


def category(c: Column) -> Column:
    """The first category whose pattern occurs, else other."""
    low, out = F.lower(c), None
    for name, pattern in CATEGORIES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def head_and_tail(c: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """Long texts as their first and last halves around a marker."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit(marker), F.right(c, F.lit(half)))).otherwise(c)


def year_of_venue(c: Column) -> Column:
    """The year that a path names as a step of its own."""
    y = F.regexp_extract(c, r"(20\d{2})(/|$)", 1)
    return F.when(y != "", y).cast("int")


def venue_group(c: Column) -> Column:
    """The venue up to its conference step, without the outcome behind it."""
    return F.regexp_replace(c, r"(?i)(/Conference)(/.*)?$", "$1")


def decision_label(c: Column, rule: str) -> Column:
    """1 accepted, 0 rejected, null unclear; the rules differ and are never mixed.

    ``accept_first``: acceptance is looked for first, a withdrawal is a rejection.
    ``reject_first``: rejection is looked for first, unclear is -1.
    ``strict``: a withdrawal is unclear, presentation forms are acceptances.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    if rule == "accept_first":
        return F.when(low.contains("accept"), 1).when(low.rlike("reject|withdraw|decline"), 0)
    if rule == "reject_first":
        return F.when(low.rlike("reject|withdraw"), 0).when(low.contains("accept"), 1).otherwise(-1)
    return F.when(low.contains("withdraw"), None).when(low.rlike("reject|decline"), 0).when(low.rlike("(^|[^a-z0-9_])accept($|[^a-z0-9_])|poster|spotlight|oral"), 1).cast("int")


def reply_kind(c: Column) -> Column:
    """The kind of a forum reply by its invitation path, hyphens and underscores alike; the first that fits."""
    low = F.regexp_replace(F.lower(c), "-", "_")
    return (
        F.when(low.rlike("(^|/)official_review$|(^|/)review$"), "official_review")
        .when(low.rlike("meta_review|metareview"), "meta_review")
        .when(low.rlike("decision"), "decision")
        .when(low.rlike("rebuttal|author_response|author_rebuttal"), "author_response")
        .when(low.rlike("official_comment|comment"), "comment")
        .otherwise("other")
    )


def json_body(c: Column) -> Column:
    """The part from the first brace to the last, code fences and thoughts stripped; null without braces."""
    t = _sub(c, (r"(?s)<think>.*?</think>", ""), (r"(?i)```(?:json)?", ""))
    start, size = F.instr(t, "{"), F.length(t)
    last = size - F.instr(F.reverse(t), "}") + 1
    return F.when((start > 0) & (F.instr(F.reverse(t), "}") > 0) & (last >= start), t.substr(start, last - start + 1))
