"""Problem 3: broken prompt and response pairs.

Noisy labelling functions, several per defect, vote 1, 0 or nothing on every answer;
an expectation-maximization label model per defect (after Dawid and Skene, 1979, and
Ratner et al., 2016) learns from the counts of the vote patterns alone how far each
can be trusted. The functions of one defect look at different things (words, script,
accents; the end, the sections, the brackets, what the caller says), so that their
errors are not one error. The patterns of one defect number at most 3 to the power of
its functions, whatever the size of the data; they alone come to the driver.

An answer keeps every defect whose posterior exceeds its cutoff. The cutoffs are
chosen on answers with planted defects: every answer that nothing speaks against is
emptied, replaced by a refusal or by a part of its prompt, cut off, or taken for the
answer to a request in another language; half of them choose, half validate
(``p3_validation``). What was planted is voted on in the same pass as the answer,
by the functions of its defect alone; counts of patterns come to the driver.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut
from folioflow.plans.sizes import bounded_rows
from folioflow.sources.tables import pruned_table

DEFECTS = ("empty", "refusal", "copied", "truncated", "other_language")
#: Cutoffs where no answers are there to choose them.
CUTOFFS = {d: 0.5 for d in DEFECTS}
#: Words in a shingle, characters in one of Chinese; the share of an answer's shingles in the prompt that speaks for a copy.
SHINGLE_WORDS, SHINGLE_CHARACTERS, COPIED_SHARE = 5, 10, 0.5
#: Sentences in which an answer declines if it does, and letters of an answer that is a remark.
OPENING, REMARK = 3, 200

# Keys whose values are quotations or names, not the reviewer's words.
QUOTED_KEYS = frozenset("excerpt quote quotation quoted_text paragraph_id paragraph_ids id category type severity verdict section confidence case_id review_language".split())
# The last part of a review, in the schema and in prose.
LAST_KEY = "limitations"
LAST_LABELS = re.compile(r"(?im)^\W*(verdict|recommendation|suggestions?|limitations|conclusion|建议|结论|推荐|总结|局限性?)\s*[*_]*\s*[:：]")
LABELS = re.compile(r"(?im)^\W*(summary|strengths?|weaknesses|concerns?|major concerns|questions?|总体评价|优点|不足|主要问题|问题|缺点)\s*[*_]*\s*[:：]")
# Answers that say nothing.
NOTHING = frozenset("na n a none null nil empty no output response answer undefined nan tbd todo 无 空 暂无 无内容".split())
# How reviews are declined.
REFUSAL = re.compile(
    r"\b(?:i|we)(?:\s+(?:am|are))?\s+(?:cannot|can\s*not|can['’]?t|could\s+not|won['’]?t|will\s+not|(?:am\s+|are\s+)?(?:unable|not\s+able)|must\s+(?:decline|refuse)|(?:have\s+to|need\s+to)\s+decline|decline|refuse|shall\s+not|am\s+not\s+(?:able|allowed|permitted))\b"
    r"|\b(?:i['’]m|we['’]re)\s+(?:unable|not\s+able|not\s+allowed|not\s+permitted|sorry)\b|\bnot\s+possible\s+for\s+me\b|\boutside\s+(?:of\s+)?what\s+i\b|\bbeyond\s+(?:my|what\s+i)\b|\bagainst\s+(?:my|the)\s+(?:guidelines|polic)|\busage\s+guidelines\b|\bcan(?:not|['’]t)\s+(?:help|assist|comply)\b"
    r"|无法|不能|不便|恕|拒绝|超出了|不予|无权|没有权限|没有资格|没有办法|没办法|不提供|不会提供|难以提供|难以完成|抱歉|很遗憾|非常遗憾|do(?:es)?\s+not\s+have\s+(?:access|permission)|don['’]t\s+have\s+(?:access|permission)|lack\s+(?:access|permission)",
    re.I,
)
REQUEST = re.compile(r"review|assess|evaluat|manuscript|paper|submission|request|comment|feedback|assist|help|评审|审稿|评价|评估|稿件|论文|请求|要求|意见|内容|提供|处理|回答|协助", re.I)
SORRY = re.compile(r"^\W*(?:i['’]?m\s+(?:very\s+)?sorry|sorry|unfortunately|apolog|thank\s+you\s+for|i\s+apologi|regrettably|as\s+an?\s+\w+(?:\s+\w+)?\s+assistant|at\s+this\s+time|很抱歉|抱歉|对不起|非常抱歉|感谢|作为|很遗憾|非常遗憾)", re.I)
# Frequent short words by language.
STOPWORDS = {
    "en": frozenset("the of and to in is that for it as was with be by on not this are from at which have has but the an or".split()),
    "fr": frozenset("le la les des et une est que pour dans qui sur pas avec par au aux du ce se nous ne été sont cette".split()),
    "es": frozenset("el la los las y una es que para en por con del se no lo al como más fue este esta su".split()),
    "de": frozenset("der die das und ist nicht von mit den für auf dem ein eine wird im zu wurde wurden dass wir des".split()),
    "pt": frozenset("o os as e uma é que para em por com do da não se ao como mais foi este esta dos das um no na".split()),
    "it": frozenset("il lo gli e una è che per in di con del non si al come più questo della dei".split()),
}

_BY_WORD: dict[str, list[str]] = {}
for _name, _words in STOPWORDS.items():
    for _w in _words:
        _BY_WORD.setdefault(_w, []).append(_name)

UNABLE_TO_TELL = re.compile(r"(?:could not|cannot|can['’]?t|unable to|无法|不能)\s*(?:find|verify|confirm|tell|see|judge|follow|reproduce|核实|确认|判断|复现|看出|验证)", re.I)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("|$)', re.S)
_OPENS = re.compile(r'\{\s*"')
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")
_FENCE = re.compile(r"```[a-z]*\s*|\s*```")
_INVISIBLE = re.compile("[​-‏ - ⁠﻿­]")
_WORD = re.compile(r"[^\W\d_]+", re.U)
_CJK = re.compile("[㐀-鿿]")
_TOKEN = re.compile(r"[^\W_]+")
_ACCENT = re.compile("[\u00c0-\u04ff]+")
_DIGIT = re.compile(r"\d")
_NO_LETTER = re.compile(r"[\W_]+")
_NOT_CHINESE = re.compile("[^㐀-鿿0-9a-z]+")
_MARK = re.compile(r"\[[a-z]+(?:-\d+)?-p\d+\]")
_PROSE_QUOTE = re.compile("“[^”]{15,}”|「[^」]{8,}」|『[^』]{8,}』|«[^»]{15,}»|\"[^\"]{15,}\"")
_END = tuple(".!?。！？…”’»）)】」』")


@dataclass
class Answer:
    """An answer taken apart: the reviewer's own strings in order, whether it is JSON, the keys, and how its brackets ended."""

    own: list[str]
    json: bool
    keys: set[str]
    unclosed: bool
    tail: str


def _depth(between: str) -> int:
    return between.count("{") + between.count("[") - between.count("}") - between.count("]")


def take_apart(raw: str | None) -> Answer:
    """One scan over strings and brackets; sound, faulty and cut-off JSON go the same way. Prose is one string."""
    text = _FENCE.sub("", _INVISIBLE.sub("", raw or "")).strip()
    start = m.start() if (m := _OPENS.search(text)) else text.find("{") if text.startswith("{") else -1
    if start < 0:
        own = _PROSE_QUOTE.sub(" ", text).strip("[]{}() \n")
        return Answer([own] if own else [], False, set(), False, text)
    own, keys, depth, key, at, open_string = [], set(), 0, "", start, False
    for m in _STRING.finditer(text, start):
        depth += _depth(text[at : m.start()])
        at = m.end()
        if m[2] == "":
            open_string = True
        if text[at : at + 20].lstrip()[:1] == ":":
            key = m[1]
            keys.add(key)
        elif key not in QUOTED_KEYS and m[1].strip():
            own.append(m[1].replace("\\n", "\n").replace('\\"', '"'))
    depth += _depth(text[at:])
    return Answer(own, True, keys, open_string or depth > 0, own[-1] if own else "")


@lru_cache(2)
def _prompt_words(prompt: str) -> tuple[list[str], set[str]]:
    words = _TOKEN.findall(prompt.lower())
    return words, set(words)


def copied_share(text: str, prompt: str, chinese: bool) -> float:
    """The share of the positions in a text at which a shingle begins that the prompt has, too."""
    if chinese:
        mine, theirs = _NOT_CHINESE.sub("", text.lower()), _NOT_CHINESE.sub("", prompt.lower())
        k = SHINGLE_CHARACTERS
        there = {theirs[i : i + k] for i in range(len(theirs) - k + 1)}
        at = len(mine) - k + 1
        return sum(mine[i : i + k] in there for i in range(at)) / at if at > 0 else 0.0
    mine, (theirs, known) = _TOKEN.findall(text.lower()), _prompt_words(prompt)
    at = len(mine) - SHINGLE_WORDS + 1
    if at <= 0:
        return 0.0
    # A shingle that is there begins with a word that is there: too few such words settle it.
    if sum(w in known for w in mine) < COPIED_SHARE * at:
        return 0.0
    there = set(zip(*(theirs[i:] for i in range(SHINGLE_WORDS)), strict=False))
    return sum(x in there for x in zip(*(mine[i:] for i in range(SHINGLE_WORDS)), strict=False)) / at


def _language(words: list[str], chinese: int) -> str | None:
    """zh, a language of the stop-word table, xx for another script; None where too little is said."""
    if chinese + len(words) < 12:
        return None
    if chinese > 0.6 * (chinese + len(words)) or chinese > 3 * len(words):
        return "zh"
    if sum(w[0] > "\u024f" for w in words) > len(words) / 3:
        return "xx"
    counts = Counter(x for w in words if w in _BY_WORD for x in _BY_WORD[w])
    if not counts:
        return None
    best, n = counts.most_common(1)[0]
    return best if n >= 0.08 * len(words) else None


def refuses(text: str) -> bool:
    """Whether one of the first sentences both declines and names what is declined; to be unable to find or verify something is no refusal."""
    return any(REFUSAL.search(s) and REQUEST.search(s) and not UNABLE_TO_TELL.search(s) for s in _SENTENCE.split(text)[:OPENING])


def _zh(run: dict) -> bool:
    return (run["review_language"] or "").lower().startswith("zh")


def _tongue(text: str, letters: int, cjk: int) -> tuple[str | None, int, int, int, int]:
    """The language of a text, its Chinese characters, other words, accented letters and letters."""
    latin = _WORD.findall(_CJK.sub(" ", text.lower()))
    return _language(latin, cjk), cjk, len(latin), sum(map(len, _ACCENT.findall(text))), letters


def _tongue_votes(tongue: tuple[str | None, int, int, int, int], asked: str) -> list[int]:
    spoken, cjk, latin, accents, letters = tongue
    chinese = cjk > 2 * latin
    by_script = -1 if cjk + latin < 12 or (asked != "zh" and not chinese) else int(chinese != (asked == "zh"))
    by_accents = -1 if asked != "en" or latin < 12 else int(accents > 0.012 * letters)
    return [-1 if spoken is None else int(spoken != asked), by_script, by_accents]


def _both(run: dict, of: tuple[str, ...] = DEFECTS) -> tuple[dict[str, list[int]], list[int] | None]:
    """The votes of the functions of some defects, and those of ``other_language`` had the answer been asked for in another language."""
    a = take_apart(run["raw_output"])
    text = " ".join(a.own)
    letters = len(_NO_LETTER.sub("", text))
    error, finish, tokens = (run["parse_error"] or "").lower(), (run["finish_reason"] or "").lower(), run["output_tokens"]
    nothing = letters == 0 or (letters < 20 and all(w in NOTHING for w in _WORD.findall(text.lower())))
    out = {}
    if "empty" in of:
        out["empty"] = [int(nothing), int(letters < 20), 1 if "empty" in error else -1, -1 if tokens is None or tokens != tokens else int(tokens <= 3)]
    if nothing:
        blank = {d: [-1] * n for d, n in FUNCTIONS.items() if d != "empty"}
        return out | {d: v for d, v in blank.items() if d in of}, blank["other_language"] if run["raw_output"] else None

    if "refusal" in of:
        # A review has parts: several strings of some length, or labels.
        parts = sum(len(x) > 40 for x in a.own) > 1 or bool(LABELS.search(text))
        said = not parts and refuses(text)
        # A complete remark about the request, of one part and without a figure: no review.
        talk = not parts and letters < REMARK and not _DIGIT.search(text) and bool(REQUEST.search(text)) and a.tail.rstrip().endswith(_END)
        out["refusal"] = [int(said), int(talk), int(not parts and bool(SORRY.match(text))), 1 if finish == "content_filter" else -1]

    cjk = len(_CJK.findall(text))
    if "copied" in of:
        share = copied_share(text, run["prompt"] or "", cjk > 0.3 * letters)
        out["copied"] = [int(share >= COPIED_SHARE), 1 if not a.json and _MARK.search(text) else -1, -1 if a.json else int(not LABELS.search(text))]

    if "truncated" in of:
        broken = not a.tail.rstrip("\"'*_ \n\t,").endswith(_END)
        unfinished = LAST_KEY not in a.keys if a.json else bool(LABELS.search(text)) and not LAST_LABELS.search(text)
        said_cut = any(x in error for x in ("unterminated", "no closing", "delimiter"))
        out["truncated"] = [int(broken), int(unfinished), 1 if a.unclosed else -1, 1 if said_cut else -1, 1 if finish == "length" else -1]

    if "other_language" not in of:
        return out, None
    tongue = _tongue(text, letters, cjk)
    out["other_language"] = _tongue_votes(tongue, "zh" if _zh(run) else (run["review_language"] or "en").lower()[:2])
    return out, _tongue_votes(tongue, "en" if _zh(run) else "zh")


def votes(run: dict) -> dict[str, list[int]]:
    """The votes of all labelling functions on one answer: 1 for the defect, 0 against, -1 none.

    An answer that says nothing gets votes on being empty alone. Null texts count as blank.
    """
    return _both(run)[0]


FUNCTIONS = {"empty": 4, "refusal": 4, "copied": 3, "truncated": 5, "other_language": 3}
_COLUMNS = ["run_id", *DEFECTS, *(f"planted_{d}" for d in DEFECTS)]
_SCHEMA = "run_id bigint, " + ", ".join(f"{c} string" for c in _COLUMNS[1:])


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for run in b.to_dict("records"):
            seen, turned = _both(run)
            bad = _planted_votes(run, turned)
            rows.append((run["run_id"], *(pattern(seen[d]) for d in DEFECTS), *(None if bad[d] is None else pattern(bad[d]) for d in DEFECTS)))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def pattern(votes_of: list[int]) -> str:
    return "".join("_01"[x + 1] for x in votes_of)


def _answered(runs: DataFrame) -> DataFrame:
    rows = runs.filter("run_id is not null and (status is null or lower(trim(status)) <> 'error')")
    return rows.select("run_id", "review_language", "prompt", "raw_output", "parse_error", "finish_reason", F.col("usage.output_tokens").alias("output_tokens"))


def labelled(runs: DataFrame) -> DataFrame:
    """``run_id``, per defect the pattern of votes, and the pattern once the defect is planted, null where it can't be; redelivered runs once, runs without an id and with status ``error`` not at all."""
    return _answered(runs).mapInPandas(_label, _SCHEMA).distinct()


# Refusals to plant.
REFUSALS = {
    "en": ("I am not able to review this paper.", "Sorry, but I can't help with an assessment of this submission.", "As a language model I have to decline this request. Please ask a human reviewer."),
    "zh": ("抱歉，我无法评审这篇论文。", "很遗憾，我不能为该稿件提供评审意见。", "作为语言模型，我无法完成这项评审请求。"),
}


_SILENT = {"parse_error": None, "finish_reason": None, "output_tokens": None}


def plant(run: dict, other: str, at: int) -> dict[str, dict]:
    """The run with each of the defects planted; ``other`` is an answer in another language, ``at`` any number that varies from run to run."""
    raw, prompt = run["raw_output"] or "", run["prompt"] or ""
    begin = (at * 7919) % max(1, len(prompt) // 2)
    outputs = {
        "empty": ("", "{}", "N/A", '{"summary": "", "major_concerns": []}')[at % 4],
        "refusal": REFUSALS["zh" if _zh(run) else "en"][at % 3],
        "copied": prompt[begin : begin + max(400, len(raw))],
        "truncated": raw[: len(raw) * (30 + at % 60) // 100],
        "other_language": other,
    }
    return {d: run | _SILENT | {"raw_output": o} for d, o in outputs.items()}


@lru_cache(64)
def _fixed_votes(defect: str, output: str) -> tuple[int, ...]:
    """The votes of a defect's functions on one of the few answers that are planted for it."""
    return tuple(_both({"raw_output": output, "prompt": None, "review_language": None, **_SILENT}, (defect,))[0][defect])


def _planted_votes(run: dict, turned: list[int] | None) -> dict[str, list[int] | None]:
    """Per defect the votes of its functions on the run with the defect planted; ``turned``: those on the answer, had it been asked for in another language."""
    bad = plant(run, "", (int(run["run_id"]) * 2654435761 >> 12) & 0xFFFFF)
    out = {d: list(_fixed_votes(d, bad[d]["raw_output"])) for d in ("empty", "refusal")}
    out |= {d: _both(bad[d], (d,))[0][d] if bad[d]["raw_output"] else None for d in ("copied", "truncated")}
    return out | {"other_language": turned}


def _half(run_id: str = "run_id") -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(2)).cast("int")


def planted(runs: DataFrame, most: int | None = None) -> DataFrame:
    """``(k, planted, ...)``: the vote patterns of all answers (of at most ``most``), as they are and with planted defects, which have the votes of their own functions alone."""
    rows = labelled(runs).withColumn("k", F.xxhash64("run_id").bitwiseAND(F.lit(2**62 - 1)))
    rows = rows if most is None else rows.orderBy("k").limit(most)
    nothing = {d: F.lit("_" * n) for d, n in FUNCTIONS.items()}
    kinds = [F.struct(F.lit("").alias("planted"), *DEFECTS)] + [F.struct(F.lit(p).alias("planted"), *[(F.col(f"planted_{d}") if d == p else nothing[d]).alias(d) for d in DEFECTS]) for p in DEFECTS]
    return rows.select("k", F.explode(F.array(*kinds)).alias("r")).select("k", "r.*").filter(" and ".join(f"{d} is not null" for d in DEFECTS))


def choose_cutoffs(rows: list[dict], chances: dict[str, dict[str, float]], half: int = 0) -> tuple[dict[str, float], list[tuple[str, int, int, int]]]:
    """:func:`best_cutoffs` of the rows of :func:`planted`; answers with a posterior of a half or more for any defect as they are count as sound for none."""
    sound = {r["k"] for r in rows if not r["planted"] and all(chances[d].get(r[d], 0.0) < 0.5 for d in DEFECTS)}
    return best_cutoffs(Counter((d, r["k"] % 2, r["planted"] == d, r[d]) for r in rows for d in DEFECTS if r["k"] in sound and r["planted"] in ("", d)), chances, half)


def best_cutoffs(counts: dict[tuple[str, int, bool, str], int], chances: dict[str, dict[str, float]], half: int = 0) -> tuple[dict[str, float], list[tuple[str, int, int, int]]]:
    """The cutoffs that tell planted from sound best on one half of the answers, and per defect (right, wrong, missed) on the other.

    counts: sound answers by defect, half, whether the defect is planted, and vote
    pattern. Of the cutoffs with the best F1 the middle of the widest gap between the
    posteriors is taken, none below that of no vote at all; one without planted answers
    is a half.
    """
    cutoffs, measured = {}, []
    for d in DEFECTS:
        scores = [sorted((chances[d].get(p, 0.0), y, n) for (of, h, y, p), n in counts.items() if of == d and h == want) for want in (half, 1 - half)]
        # What gets no vote at all is never flagged.
        silent = chances[d].get("_" * FUNCTIONS[d], 0.0)
        edges = sorted({silent, 1.0, *(x for x, _, _ in scores[0] if x > silent)})
        best, there = (-1.0, 0.0, 0.5), sum(n for _, y, n in scores[0] if y)
        for lo, hi in zip(edges, edges[1:], strict=False):
            right = sum(n for x, y, n in scores[0] if y and x > lo)
            f1 = 2 * right / max(1, sum(n for x, _, n in scores[0] if x > lo) + there)
            best = max(best, (f1, hi - lo, (lo + hi) / 2))
        cutoffs[d] = best[2] if there else CUTOFFS[d]
        said = [(x > cutoffs[d], y, n) for x, y, n in scores[1]]
        measured.append((d, sum(n for a, b, n in said if a and b), sum(n for a, b, n in said if a and not b), sum(n for a, b, n in said if b and not a)))
    return cutoffs, measured


def posteriors(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Per vote pattern the probability of the defect, by expectation-maximization over the pattern counts.

    Each function has P(vote 1 | defect or not) among its votes; not to vote says
    nothing. It starts from the belief that votes are right nine times in ten, and
    keeps that belief with the weight of a twentieth of the data, so that a rare
    defect isn't explained away. No patterns give no posteriors.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    said = np.array([[c == "1" for c in p] for p in patterns], float)
    cast = np.array([[c != "_" for c in p] for p in patterns], float)
    belief = np.array([[0.1] * said.shape[1], [0.9] * said.shape[1]])
    table, rate, weight = belief.copy(), 0.05, 0.05 * n.sum()
    for _ in range(rounds):
        score = [np.log(r) + cast @ np.log(1 - t) + (cast * said) @ (np.log(t) - np.log(1 - t)) for r, t in ((1 - rate, table[0]), (rate, table[1]))]
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        before = rate
        rate = float(np.clip((n * p).sum() / max(1.0, n.sum()), 1e-4, 0.5))
        for y, mass in ((0, n * (1 - p)), (1, n * p)):
            # The belief weighs as much as a share of the class it speaks of.
            w = weight * (rate if y else 1 - rate) + 1e-6
            table[y] = np.clip((mass @ (cast * said) + w * belief[y]) / (mass @ cast + w), 1e-6, 1 - 1e-6)
        if abs(rate - before) < 1e-9:
            break
    return dict(zip(patterns, p.tolist(), strict=True))


def _model(runs: DataFrame) -> tuple[DataFrame, dict[str, dict[str, float]], dict[str, float], list[tuple[str, int, int, int]]]:
    rows = cut(labelled(runs))
    # Patterns that no answer has get a posterior, too: planted answers may have them.
    every = {d: dict.fromkeys(map("".join, itertools.product("_01", repeat=FUNCTIONS[d])), 0) for d in DEFECTS}
    chances = {d: posteriors(every[d] | {r[d]: r["count"] for r in bounded_rows(rows.groupBy(d).count(), 3 ** FUNCTIONS[d], "vote patterns")}) for d in DEFECTS}
    suspect = [F.col(d).isin([p for p, x in chances[d].items() if x >= 0.5]) for d in DEFECTS]
    kinds = [F.struct(F.lit(d).alias("defect"), F.lit(y).alias("y"), F.col(f"planted_{d}" if y else d).alias("p")) for d in DEFECTS for y in (False, True)]
    sound = rows.filter(~reduce(Column.__or__, suspect)).select(_half().alias("half"), F.explode(F.array(*kinds)).alias("r")).filter("r.p is not null")
    counts = bounded_rows(sound.groupBy("r.defect", "half", "r.y", "r.p").count(), sum(4 * 3**n for n in FUNCTIONS.values()), "patterns of planted answers")
    return rows, chances, *best_cutoffs({(r["defect"], r["half"], r["y"], r["p"]): r["count"] for r in counts}, chances)


def defects(runs: DataFrame) -> DataFrame:
    """``(run_id, defects)``: all defects of each answer whose posterior exceeds the cutoff, in the order of DEFECTS; runs without any are left out."""
    rows, chances, cutoffs, _ = _model(runs)
    flags = []
    for d in DEFECTS:
        bad = [p for p, x in chances[d].items() if x > cutoffs[d]]
        flags.append(F.when(F.col(d).isin(bad) if bad else F.lit(False), F.lit(d)))
    return rows.select("run_id", F.array_compact(F.array(*flags)).alias("defects")).filter("size(defects) > 0")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return pruned_table(spark, folder, "eval_runs", ["run_id", "review_language", "prompt", "status", "raw_output", "parse_error", "finish_reason", "usage.output_tokens"])


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective run with the first defect that fits."""
    return defects(_runs(spark, folder)).select("run_id", F.element_at("defects", 1).alias("defect")).distinct()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective run with all its defects."""
    return defects(_runs(spark, folder)).select("run_id", F.explode("defects").alias("defect")).distinct()


def validation(spark: SparkSession, folder: str) -> DataFrame:
    """Per defect its cutoff and, on the planted answers that did not choose it, how many were found, missed and wrongly flagged."""
    _, _, cutoffs, measured = _model(_runs(spark, folder))
    return spark.createDataFrame([(d, round(cutoffs[d], 6), right, missed, wrong) for d, right, wrong, missed in measured], "defect string, cutoff double, found int, missed int, wrong int")


QUERIES = {"p3_found": found, "p3_labels": labels, "p3_validation": validation}
ORACLE: dict[str, str] = {}
