import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.titles import K_SLIPS, candidates, cuts, edits, near_titles, places, slips, spaced, title_words


@pytest.mark.parametrize(
    "written",
    [
        "Learning a monotone simulator from glaciology: Klulnál for text simplification",
        "LEARNING A MONOTONE SIMULATOR FROM GLACIOLOGY - KLULNAL FOR TEXT SIMPLIFICATION.",
        "<i>Learning monotone simulator from  glaciology: Klulnal for text simplification</i>",
        "Title: Learning a monotone simulator from glaciology: Klulnal for text simplification [Withdrawn]",
        "\\textbf{Learning a monotone simulator from glaciology: Klulnal for text simplification} (Extended Version)",
        "Ｌｅａｒｎｉｎｇ a monotone simulator from glaciology: Klulnal for text simplification -- preprint",
        "* Learning\xa0a\xa0monotone simulator from glaciology: Klulnal for text simplification   camera ready",
    ],
)
def test_ways_of_writing_one_title(written):
    assert title_words(written) == ["learning", "monotone", "simulator", "glaciology", "klulnal", "text", "simplification"]


def test_chinese_titles():
    assert title_words("《基于校准摘要模型的 神经科学聚类分析研究（Miton）》（终稿）") == title_words("基于校准摘要模型的神经科学聚类分析研究(Miton)")


@pytest.mark.parametrize("nothing", [None, "", "  ", "Untitled", "(no title)", "untitled manuscript", "Anonymous Submission", "TBD", "无标题", "Paper under review", "---"])
def test_placeholders(nothing):
    assert title_words(nothing) == []


def test_slips_and_other_words():
    assert slips("learning gated simulator", "learning gated simlator") == [("simulator", "simlator")]
    assert slips("tanren view part i policy", "tanren view part ii policy") is None
    assert slips("parsing 41 languages parser", "parsing 21 languages parser") is None
    assert slips("rethinking grounding radiology", "rethinking translation radiology") is None
    assert slips("question answering legal", "question answering fro legal") == []


def test_places_hold_an_intact_segment():
    """Whatever at most k edits do to a string, one of its segments stands at an allowed place."""
    r = random.Random(5)
    for _ in range(400):
        n, k = r.randrange(4, 14), 3
        a = [r.choice("abc") for _ in range(n)]
        b = list(a)
        for _ in range(r.randrange(k + 1)):
            x = r.randrange(3)
            i = r.randrange(len(b))
            b[i : i + 1] = [] if x == 0 and len(b) > 1 else ["z"] if x == 1 else [b[i], "y"]
        assert any(b[q : q + z] == a[s : s + z] for i, (s, z) in enumerate(cuts(n, k)) for q in places(i, s, z, n, len(b), k))


@pytest.mark.parametrize("hot", [2, 1000])
def test_join_against_all_pairs(spark, hot):
    r = random.Random(3)
    vocabulary = "neural sparse planner decoder parsing radiology finance routing adaptive latent graph corpus survey tokens".split()
    titles = [" ".join(r.sample(vocabulary, r.randrange(2, 8)) + ["".join(r.choice("bdklmnrstaeiou") for _ in range(7))]) for _ in range(60)]
    for t in titles[:40]:
        for _ in range(2):
            w = list(t)
            i = r.randrange(len(w) - 1)
            w[i : i + 1] = r.choice([[], [w[i], w[i]], ["q"]]) if w[i] != " " else [" "]
            titles.append("".join(w))
    titles = sorted({" ".join(t.split()) for t in titles})
    rows = [(t, i % 2 == 0, i % 3 != 0) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "words string, evaluation boolean, training boolean")
    got = {(x.e, x.t) for x in near_titles(df, hot).collect()}
    count = {}
    for t in titles:
        for w in set(t.split(" ")):
            count[w] = count.get(w, 0) + 1

    def same(e, t):
        s = slips(e, t)
        return s is not None and all(min(count[x], count[y]) <= 2 or min(count[x], count[y]) * 10 <= max(count[x], count[y]) for x, y in s)

    assert got == {(e, t) for e, ev, _ in rows if ev for t, _, tr in rows if tr if e != t and same(e, t)}
    assert got


def test_no_titles(spark):
    assert near_titles(spark.createDataFrame([], "words string, evaluation boolean, training boolean")).count() == 0
    assert near_titles(spark.createDataFrame([("a", True, True)], "words string, evaluation boolean, training boolean").withColumn("key", F.lit(1))).count() == 0


def _misspelled(w, r):
    """A word with one slip: a letter too many, too few, another or swapped with the next."""
    while True:
        i = r.randrange(len(w) - 1)
        x = w[:i] + r.choice([w[i + 1], "q" + w[i:], "q" + w[i + 1 :], w[i + 1] + w[i] + w[i + 2 :]])
        x = x if len(x) > 2 else w
        if x != w and edits(x, w, 1) == 1:
            return x


def test_a_spaced_segment_survives_swaps():
    r = random.Random(8)
    for _ in range(1000):
        n, k = r.randrange(9, 40), 4
        a = [r.choice("abc") for _ in range(n)]
        b = list(a)
        for i in sorted(r.sample(range(0, n - 1, 2), k), reverse=True):
            b[i : i + 2] = r.choice([[b[i + 1], b[i]], b[i : i + 1], ["z", *b[i : i + 2]], ["z", b[i + 1]]])
        assert any(b[q : q + z] == a[s : s + z] for i, (s, z) in enumerate(spaced(n, k)) for q in places(i, s, z, n, len(b), k))


@pytest.mark.parametrize("hot", [2, 1000])
def test_all_that_slips_accepts_is_compared(spark, hot):
    """Four slips at all places, joined words and slipped little words, against brute force."""
    r = random.Random(11)
    base = "monotone pricing benchmark selfish supervised multimodal grounding 3d".split()
    made = set()
    for where in itertools.combinations(range(len(base) - 1), K_SLIPS):
        made.add(" ".join(_misspelled(w, r) if i in where else w for i, w in enumerate(base)))
    for joins in itertools.product([" ", ""], repeat=len(base) - 1):
        made.add("".join(w + x for w, x in zip(base, [*joins, ""], strict=True)))
    for where in itertools.combinations(range(len(base) + 1), 3):
        made.add(" ".join(w for i in range(len(base) + 1) for w in (["wiht"] if i in where else []) + base[i : i + 1]))
    made |= {"diffusion", "difusion", "ab ab abab", "ababab ab", "校准摘要", "校准 摘要", "校准模型"}
    titles = sorted(made)
    of = lambda some: spark.createDataFrame([(t,) for t in some], "words string")
    got = {(x.e, x.t) for x in candidates(of(titles[::2]), of(titles[1::2]), hot).collect()}
    wanted = {(e, t) for e in titles[::2] for t in titles[1::2] if slips(e, t) is not None}
    assert wanted and not wanted - got


def test_four_slips_and_joined_words_are_found(spark):
    pairs = [
        ("towards monosone prricing runirfi becnhmark", "towards monotone pricing runtirfi benchmark"),
        ("learning selfsupervised multimodal graphneural representations bases", "learning self supervised multimodal graph neural representations bases"),
    ]
    df = spark.createDataFrame([(e, True, False) for e, _ in pairs] + [(t, False, True) for _, t in pairs], "words string, evaluation boolean, training boolean")
    assert {(x.e, x.t) for x in near_titles(df).collect()} == set(pairs)


def test_titles_of_three_letters_and_fewer(spark):
    df = spark.createDataFrame([("gans", True, False), ("vit", True, False), ("gan", False, True), ("vits", False, True), ("ab", False, True)], "words string, evaluation boolean, training boolean")
    assert {(x.e, x.t) for x in near_titles(df).collect()} == {("gans", "gan"), ("vit", "vits")}
