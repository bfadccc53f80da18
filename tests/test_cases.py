import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import hashing, text
from folioflow.operators import calibration, cases, ranks, validation


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_packs_of_sentences(spark):
    long = " ".join(f"Sentence number {i} says something." for i in range(40))
    packs = one(spark, long, "string", lambda c: text.packed_sentences(c, 100, 120))
    assert " ".join(packs) == long and all(len(p) <= 120 for p in packs) and len(packs) > 5
    assert one(spark, "short", "string", lambda c: text.packed_sentences(c, 100, 50)) == ["short"]
    assert one(spark, "x" * 300 + ". Then this.", "string", lambda c: text.packed_sentences(c, 100, 50)) == ["x" * 300 + ".", "Then this."]


def test_case_paragraphs(spark):
    body = "A paragraph that is long enough to be kept, with some words more. " * 2
    rows = [("a", f"# Conclusion\n{body}\n\nshort\n# Abstract\n{body}\n# References\n{body}"), ("b", body), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "id string, md string").withColumn("place", F.lit("clash"))
    got = {}
    for r in cases.case_paragraphs(df.drop("place"), "id", "md").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.section, r.paragraph_id))
    assert got == {"a": [("Abstract", "section-02-p001"), ("Conclusion", "section-01-p001")], "b": [("Manuscript", "section-01-p001")]}
    cut = cases.case_paragraphs(df.drop("place"), "id", "md", budget=200).filter("id = 'a'").orderBy("place").collect()
    assert [len(r.text) for r in cut] == [len(body.strip()), 200 - len(body.strip())]
    assert one(spark, rows[0][1], "string", lambda c: cases.excerpt(c, 400)).startswith("## Abstract\n") and one(spark, None, "string", lambda c: cases.excerpt(c, 400)) == ""


def test_within_budget(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 40), ("a", 3, 20), ("a", 4, 1), ("b", 1, 500), ("b", 2, 1)], "k string, no int, n int")
    got = {(r.k, r.no): r.taken for r in cases.within_budget(df, "k", "no", "n", 100, 9).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): False, ("b", 1): True, ("b", 2): False}


def test_quantiles_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), r.choice([None, r.randrange(50) / 2])) for _ in range(400)] + [("one", 3.0), ("none", None)]
    wanted = {f"{rule}{i}": (q, rule) for rule in ranks.PLACES for i, q in enumerate((0.0, 0.5, 0.95, 1.0))}
    got = {x.g: x for x in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted).collect()}
    assert set(got) == {"x", "y", None, "one"}
    for g, row in got.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        n = len(v)
        places = {"linear": lambda q: (n - 1) * q, "nearest_rank": lambda q: max(math.ceil(n * q) - 1, 0), "truncated": lambda q: min(math.floor(n * q), n - 1), "rounded": lambda q: math.floor((n - 1) * q + 0.5)}
        for name, (q, rule) in wanted.items():
            p = places[rule](q)
            lo, hi = v[math.floor(p)], v[math.ceil(p)]
            assert abs(row[name] - (lo + (hi - lo) * (p - math.floor(p)))) < 1e-9, (g, name)


def test_strict_lookup(spark):
    df, good = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(x.v for x in validation.strict_lookup(df, good, "k").collect()) == ["a", "a", "b"]
    for bad in (good.filter("k < 2"), good.unionByName(good)):
        with pytest.raises(ValueError):
            validation.strict_lookup(df, bad, "k")
    with pytest.raises(ValueError):
        validation.strict_lookup(df.unionByName(spark.createDataFrame([(None,)], "k int")), good, "k")


def test_newton_platt_and_tiers(spark):
    r = random.Random(5)
    rows = [(x, int(r.random() < 1 / (1 + math.exp(-(2 * x - 0.5))))) for x in (r.gauss(0, 1) for _ in range(3000))]
    df = spark.createDataFrame(rows, "x double, y int")
    w, b = calibration.logistic_regression(df, ["x"], "y", 0.005)
    for k in range(2):  # the gradient vanishes there
        g = sum((1 / (1 + math.exp(-(w[0] * x + b))) - y) * (x if k == 0 else 1) for x, y in rows) / len(rows) + (0.005 * w[0] if k == 0 else 0)
        assert abs(g) < 1e-8
    assert calibration.platt(df, "x", "y") == (w[0], b) and calibration.platt(df.limit(9), "x", "y") == (1.0, 0.0) and calibration.platt(df.filter("y = 1"), "x", "y") == (1.0, 0.0)
    tiers = spark.createDataFrame([(100, 200, 0.05), (99, 200, 0.05), (29, 500, 0.01), (100, 200, None)], "s int, n int, e double").select(calibration.confidence_tier(F.col("s"), F.col("n"), F.col("e")).alias("t")).collect()
    assert [x.t for x in tiers] == ["high", "medium", "low", "low"]


def test_small_texts(spark):
    assert one(spark, "see &#8217;s &#x41; &#65; &#128512; &#99999999;", "string", text.decode_html) == "see ’s &#x41; A 😀 &#99999999;"
    assert one(spark, "as shown (Smith et al., 2020; Lee 2019a) by Kim and Park (2018) it is [3, 4]", "string", text.clean_evidence) == "as shown by it is"
    assert one(spark, "Graph-neural nets for intent detection", "string", lambda c: text.scope_hits(c, ["graph-neural", "intent detection", "nets", "model"])) == ["graph-neural", "intent detection"]
    assert one(spark, " CC-by  4.0 International", "string", text.normalize_license) == "CC BY 4.0"
    kinds = {"V/-/Official_Review": "official_review", "V/-/Meta_Review": "meta_review", "V/-/Decision": "decision", "V/-/Author_Rebuttal": "author_response", "V/-/Comment": "comment", "V/-/X": "other"}
    assert {k: one(spark, k, "string", text.reply_kind) for k in kinds} == kinds
    digests = [spark.createDataFrame([(h,) for h in hs], "h string").agg(hashing.set_digest(F.col("h")).alias("d")).first().d for hs in (["aa" * 32, "bb" * 32], ["bb" * 32, "aa" * 32], ["aa" * 32])]
    assert digests[0] == digests[1] != digests[2]
