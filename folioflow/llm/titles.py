"""Problem 6: same or near-same records across splits.

A segment join under edit distance (after Li, Deng, Wang and Feng, "Pass-Join", 2011).
A title is compared by its characters without blanks, so that joined words are equal.
A string of the training split is cut into k+1 segments, k being the slips that the
verification accepts; k edits leave one of them intact, which then stands in the
evaluation string at one of few positions, given by the edits possible before and
after it. Strings that meet on a segment are verified by banded dynamic programming
over the characters and then word by word.

Equal strings are one class, however many records bear them. A segment on which many
pairs meet is not joined as it is: within it, what is left of both strings is cut
again, so that a pair must agree on a second segment too, and so on; what still is
hot after LEVELS cuts is joined in salted parts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.identity import split_of
from folioflow.llm.splits import submissions
from folioflow.operators.sparse import Joined
from folioflow.plans.lineage import cut
from folioflow.sources.tables import pruned_table

#: Slips between two titles; characters that may differ by them, a swap of neighbours being two.
K_SLIPS = 4
K_CHARACTERS = 2 * K_SLIPS
#: Pairs that meet on one segment from which it is cut once more, and the most cuts.
HOT, LEVELS = 1024, 4

# Little words, which a title may gain or lose.
LITTLE = frozenset("a an the and or of in on for with to from by at as into via its is are be".split())
# Words of a note on version or status.
STATUS = frozenset(
    "withdrawn withdrawal resubmission resubmitted revised revision revise extended full short long version paper camera ready preprint draft final submitted submission accepted rejected retracted updated corrected arxiv workshop anonymous anonymized anonymised under review manuscript copy latest new v".split()
)
NOTES = tuple(tuple(x.split()) for x in ("camera ready", "extended version", "full version", "final version", "full paper", "preprint", "resubmission", "withdrawn"))
STATUS_CJK = frozenset("终稿 修订稿 修改稿 扩展版 重投 预印本 撤稿 草稿 初稿 完整版 已撤回 已撤稿 修订版 最终版 修改版 长文 正式版 再投稿 投稿版 预印版 增补版 新版".split())
# Words of which placeholders consist.
PLACEHOLDER = frozenset("untitled manuscript anonymous submission no not title titled paper under review tbd tba na n none null nan unknown draft missing to determined decided document test placeholder available given".split())
PLACEHOLDER_CJK = frozenset("无标题 无题 未命名 待定 匿名投稿 暂无标题 无 标题 论文 投稿 审稿中 评审中 未提供 匿名".split())
# Letters that decomposition leaves alone.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "&": " and "})

_CJK = "\u3400-\u9fff\uf900-\ufaff"
_TOKEN = re.compile(f"[a-z]+|[0-9]+|[{_CJK}]+|[^\\W_]+")
_BRACKET = re.compile(r"[\(\[{【〔〈]([^()\[\]{}【】〔〕〈〉]{1,60})[\)\]}】〕〉]")
_ROMAN = re.compile("[ivxlcdm]+")
_LATIN = re.compile("[A-Za-z]+")


def _status(words: list[str]) -> bool:
    return bool(words) and all(w in STATUS or w in STATUS_CJK or (w.isdigit() and len(w) <= 2) for w in words) and not all(w.isdigit() for w in words)


def title_words(title: str | None) -> list[str]:
    """The content words of a title; none for a missing title or a placeholder.

    Gone are letter case and form, accents, punctuation, spacing, markup, little
    words and notes on version or status.
    """
    if not title:
        return []
    t = unicodedata.normalize("NFKC", html.unescape(title)).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LETTERS)
    t = re.sub(r"<[^<>]{0,80}>", " ", t)
    t = re.sub(r"\\[a-z]+\s*", " ", t)
    t = re.sub(r"^[\W_]*(title|标题|题目)\s*[:：]", " ", t)
    t = re.sub(f"(?<=[{_CJK}])\\s+(?=[{_CJK}])", "", t)
    t = _BRACKET.sub(lambda m: " " if _status(_TOKEN.findall(m[1])) else m[0], t)
    parts = re.split(r"\s+[-–—―‐‑‒−:|·]+\s+|[|·]|[:：]\s+|——|--+", t)
    while len(parts) > 1 and (_status(_TOKEN.findall(parts[-1])) or not _TOKEN.findall(parts[-1])):
        parts.pop()
    words = [w.replace("的", "") for p in parts for w in _TOKEN.findall(p)]
    if all(w in PLACEHOLDER or w in PLACEHOLDER_CJK or w.isdigit() or w in LITTLE for w in words):
        return []
    for note in NOTES:
        if len(words) > len(note) + 1 and tuple(words[-len(note) :]) == note:
            words = words[: -len(note)]
    content = [w for w in words if w and w not in LITTLE]
    return content or words


@F.pandas_udf(T.StringType())
def title_key(titles: pd.Series) -> pd.Series:
    """The content words of a title, joined by blanks; null where there are none."""
    return titles.map(lambda t: " ".join(title_words(t)) or None)


def cuts(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k+1 even segments of n symbols; the later ones take the rest."""
    base, more = divmod(n, k + 1)
    at, out = 0, []
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def places(i: int, start: int, size: int, n: int, m: int, k: int) -> range:
    """Where segment i of a string of n symbols may stand in one of m, if k edits lead from one to the other.

    At most i edits before it, at most k-i after it (the multi-match-aware bound).
    """
    d = m - n
    return range(max(0, start - i, start + d - (k - i)), min(m - size, start + i, start + d + (k - i)) + 1)


def spaced(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of k+1 segments of n symbols with a symbol between each two: a swap of neighbours spoils only one."""
    return [(at + i, size) for i, (at, size) in enumerate(cuts(n - k, k))]


def _h(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - 2**63


def _segments(text: str, what: str, k: int) -> list[tuple[int, int, int]]:
    """(key, start, size) of the segments of a training string."""
    n = len(text)
    if n <= 2 * k:
        return [(_h(what, "all"), 0, 0)]
    return [(_h(what, n, i, text[s : s + z]), s, z) for i, (s, z) in enumerate(spaced(n, k))]


def _substrings(text: str, what: str, k: int) -> list[tuple[int, int, int]]:
    """(key, start, size) of all substrings of an evaluation string that may equal a segment."""
    m = len(text)
    out = [(_h(what, "all"), 0, 0)] if m <= 3 * k else []
    for n in range(max(2 * k + 1, m - k), m + k + 1):
        for i, (s, z) in enumerate(spaced(n, k)):
            out += [(_h(what, n, i, text[q : q + z]), q, z) for q in places(i, s, z, n, m, k)]
    return out


def texts(words: str) -> list[str]:
    """A title without blanks, once for each choice of words that slips() may leave out.

    Of two titles that slips() accepts, two texts are within K_SLIPS edits: joined
    words are equal there. ``title_words`` leaves no little words but in titles of nothing else.
    """
    made = {"": 0}
    for w in words.split(" "):
        longer = {text + w: cost for text, cost in made.items()}
        if (n := _little(w)) is not None:
            for text, cost in made.items():
                if cost + n <= K_SLIPS:
                    longer[text] = min(cost + n, longer.get(text, K_SLIPS))
        made = longer
    return list(made)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(w, x) for w in b["words"] for x in texts(w)], columns=["words", "text"])


def _emit(cut_up: Callable[[str, str, int], list[tuple[int, int, int]]]):
    """A mapInPandas step from (key, text, rest, start, size) to the segments of what is left of each string, under the key so far."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), _ROWS_AT_ONCE):
                rows = []
                for key, text, rest, start, size in b[at : at + _ROWS_AT_ONCE].itertuples(index=False):
                    # No slip touches what is not a letter from a to z: it is part of the key.
                    rest, under = rest[:start] + rest[start + size :], str(key) if key else _LATIN.sub("", text)
                    rows += [(again, text, rest, s, z) for again, s, z in cut_up(rest, under, K_SLIPS)]
                yield pd.DataFrame(rows, columns=["key", "text", "rest", "start", "size"])

    return step


_ROWS = "key bigint, text string, rest string, start int, size int"
_ROWS_AT_ONCE = 1000


def candidates(evaluation: DataFrame, training: DataFrame, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """Pairs ``(e, t)`` of different strings of which two texts agree on a segment and are within the characters that may differ."""
    # Cutting up is work for Python: the few rows of a small table must not lie in one or two tasks.
    tasks = int(evaluation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_e, of_t = (cut(x.select("words").repartition(tasks, "words").mapInPandas(_texts, "words string, text string")) for x in (evaluation, training))
    first = lambda x: x.select(F.lit(0).cast("bigint").alias("key"), "text", F.col("text").alias("rest"), F.lit(0).alias("start"), F.lit(0).alias("size")).repartition(tasks, "text").distinct()
    e, t = first(of_e), first(of_t)
    near, pairs = F.levenshtein("te", "tt", K_CHARACTERS) >= 0, None
    for level in range(levels):
        t, e = cut(t.mapInPandas(_emit(_segments), _ROWS)), e.mapInPandas(_emit(_substrings), _ROWS)
        # Of all substrings only those that meet a segment go on.
        e = cut(e.join(t.select("key").distinct(), "key", "left_semi").select("key", "text", "rest", "start", "size"))
        counts = t.groupBy("key").agg(F.count("*").alias("nt")).join(e.groupBy("key").agg(F.count("*").alias("ne")), "key")
        many = cut(counts.filter(F.col("nt") * F.col("ne") >= hot).select("key"))
        last = level == levels - 1 or not many.take(1)
        part = t if last else t.join(many, "key", "left_anti")
        left, right = part.select("key", F.col("text").alias("tt")), e.select("key", F.col("text").alias("te"))
        met = (Joined(cut(left), "key", "tt", 1, 0, hot).with_vector(right) if last and level else left.join(right, "key")).filter(near).select("te", "tt")
        pairs = met if pairs is None else pairs.unionByName(met)
        if last:
            break
        t, e = (x.join(many, "key", "left_semi").select("key", "text", "rest", "start", "size") for x in (t, e))
    named = pairs.distinct().join(of_e.select(F.col("words").alias("e"), F.col("text").alias("te")), "te").join(of_t.select(F.col("words").alias("t"), F.col("text").alias("tt")), "tt")
    return named.select("e", "t").filter("e <> t").distinct()


def edits(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours as one) between two words by banded dynamic programming; most+1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            v = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            nxt[j] = v
        if min(nxt) > most:
            return most + 1
        before, row = row, nxt
    return row[-1]


def slip(a: str, b: str) -> int | None:
    """The slips that turn one word into the other, or None: they are different words."""
    long = max(len(a), len(b))
    if not (a.isascii() and b.isascii() and a.isalpha() and b.isalpha()) or long < 3 or (_ROMAN.fullmatch(a) and _ROMAN.fullmatch(b)):
        return None
    most = 1 if long < 6 else 2
    n = edits(a, b, most)
    return n if n <= most else None


@lru_cache(100_000)
def _little(w: str) -> int | None:
    if w in LITTLE:
        return 0
    return 1 if w.isascii() and w.isalpha() and 2 <= len(w) <= 6 and any(edits(w, x, 1) <= 1 for x in LITTLE if len(x) > 2) else None


def slips(e: str, t: str) -> list[tuple[str, str]] | None:
    """The words that differ by slips if nothing else but little words does, by dynamic programming over the words; None otherwise."""
    a, b = e.split(" "), t.split(" ")
    best: dict[tuple[int, int], tuple[int, list[tuple[str, str]]]] = {(0, 0): (0, [])}

    def offer(at: tuple[int, int], cost: int, pairs: list[tuple[str, str]]) -> None:
        if cost <= K_SLIPS and (at not in best or best[at][0] > cost):
            best[at] = (cost, pairs)

    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if (i, j) not in best:
                continue
            cost, pairs = best[i, j]
            if i < len(a) and j < len(b):
                if a[i] == b[j]:
                    offer((i + 1, j + 1), cost, pairs)
                elif (n := slip(a[i], b[j])) is not None:
                    offer((i + 1, j + 1), cost + n, [*pairs, (a[i], b[j])])
                if i + 1 < len(a) and a[i] + a[i + 1] == b[j]:
                    offer((i + 2, j + 1), cost, pairs)
                if j + 1 < len(b) and b[j] + b[j + 1] == a[i]:
                    offer((i + 1, j + 2), cost, pairs)
            if i < len(a) and (n := _little(a[i])) is not None:
                offer((i + 1, j), cost + n, pairs)
            if j < len(b) and (n := _little(b[j])) is not None:
                offer((i, j + 1), cost + n, pairs)
    end = best.get((len(a), len(b)))
    return None if end is None else end[1]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(e, t, [{"x": x, "y": y} for x, y in p]) for e, t in zip(b["e"], b["t"], strict=True) if (p := slips(e, t)) is not None]
        yield pd.DataFrame(rows, columns=["e", "t", "slips"])


def near_titles(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs ``(e, t)`` of different title strings that are the same but for slips and little words.

    classes: ``words`` with ``evaluation`` and ``training``, whether a record of
    these splits bears it. Two words that are both established in the titles are
    different words, however close: a slip is rare beside its word.
    """
    found = candidates(classes.filter("evaluation").select("words"), classes.filter("training").select("words"), hot)
    verified = found.mapInPandas(_verify, "e string, t string, slips array<struct<x string, y string>>")
    verified = verified.withColumn("id", F.xxhash64("e", "t"))
    counts = classes.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    used = verified.select("id", "e", "t", F.explode("slips").alias("s")).select("id", "e", "t", F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    of = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    rare = F.least("n_x", "n_y")
    bad = used.join(of("x"), "x").join(of("y"), "y").filter((rare > 2) & (rare * 10 > F.greatest("n_x", "n_y"))).select("e", "t")
    return verified.select("e", "t").join(bad, ["e", "t"], "left_anti")


def titled(spark: SparkSession, folder: str) -> DataFrame:
    """``(case_id, split, words)`` of the records of a split; words null for no title."""
    t = pruned_table(spark, folder, "cases", ["case_id", "source.split", "manuscript.title"])
    return t.select("case_id", split_of(F.col("source.split")).alias("split"), title_key("manuscript.title").alias("words")).filter("case_id is not null and split is not null").distinct()


def _pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    e, t = left.select(on, F.col("case_id").alias("e_case")), right.select(on, F.col("case_id").alias("t_case"))
    return e.join(t, on).select("e_case", "t_case")


def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """``(e_case, t_case)``: the evaluation record and the training record, by submission or by title; distinct."""
    rows = cut(titled(spark, folder))
    borne = rows.filter("words is not null")
    evaluation, training = borne.filter("split <> 'train'"), borne.filter("split = 'train'")
    classes = cut(borne.groupBy("words").agg(F.max(F.col("split") != "train").alias("evaluation"), F.max(F.col("split") == "train").alias("training")))
    near = near_titles(classes)
    by_title = _pairs(evaluation, training, "words")
    by_near = _pairs(evaluation.withColumnRenamed("words", "e").join(near, "e").select("case_id", F.col("t").alias("words")), training, "words")
    grouped = submissions(spark, folder).filter("case_id is not null and submission is not null and split is not null")
    by_group = _pairs(grouped.filter("split <> 'train'"), grouped.filter("split = 'train'"), "submission")
    return by_title.unionByName(by_near).unionByName(by_group).filter("e_case <> t_case").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a training record with a validation or test record, smaller id first."""
    return overlaps(spark, folder).select(F.least("e_case", "t_case").alias("case_id_a"), F.greatest("e_case", "t_case").alias("case_id_b")).distinct()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs and the evaluation records in them, per split and dataset of the evaluation record."""
    t = pruned_table(spark, folder, "cases", ["case_id", "source.split", "source.dataset"])
    of = t.select(F.col("case_id").alias("e_case"), split_of(F.col("source.split")).alias("split"), F.col("source.dataset").alias("dataset")).distinct()
    return overlaps(spark, folder).join(of, "e_case").groupBy("split", "dataset").agg(F.count("*").alias("pairs"), F.countDistinct("e_case").alias("records"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Per validation or test record how many training records share its submission, bear its title, or one that is nearly the same: counts of classes, no pairs of records."""
    rows = cut(titled(spark, folder))
    borne = rows.filter("words is not null")
    classes = cut(borne.groupBy("words").agg(F.max(F.col("split") != "train").alias("evaluation"), F.max(F.col("split") == "train").alias("training"), F.countDistinct(F.when(F.col("split") == "train", F.col("case_id"))).alias("n")))
    near = near_titles(classes).join(classes.select(F.col("words").alias("t"), "n"), "t").groupBy(F.col("e").alias("words")).agg(F.sum("n").alias("near_title"))
    grouped = submissions(spark, folder).filter("case_id is not null and split is not null")
    per = grouped.filter("submission is not null and split = 'train'").groupBy("submission").agg(F.countDistinct("case_id").alias("same_submission"))
    evaluation = rows.filter("split <> 'train'").join(classes.select("words", F.col("n").alias("same_title")), "words", "left").join(near, "words", "left").groupBy("case_id").agg(F.max("same_title").alias("same_title"), F.max("near_title").alias("near_title"))
    of = grouped.filter("split <> 'train'").join(per, "submission", "left").groupBy("case_id").agg(F.max("same_submission").alias("same_submission"))
    return evaluation.join(of, "case_id").na.fill(0).filter("same_submission + same_title + near_title > 0")


QUERIES = {"p6_found": found, "p6_counted": counted, "p6_links": links}
ORACLE: dict[str, str] = {}
