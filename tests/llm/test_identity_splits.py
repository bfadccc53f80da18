import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.identity import forum_of, split_of, venue_of
from folioflow.llm.splits import assign_splits, entity_components


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("said", "meant"),
    [("train", "train"), (" TRAIN ", "train"), ("training", "train"), ("dev", "validation"), ("val ", "validation"), ("Valid", "validation"), ("2026-heldout-test", "test"), ("test_split", "test"), ("smoke", None), ("", None), (None, None), ("latest", None)],
)
def test_split(spark, said, meant):
    assert one(spark, split_of, said) == meant


@pytest.mark.parametrize(
    ("said", "meant"),
    [("ABcd123456", "ABcd123456"), (" ABcd123456\n", "ABcd123456"), ("forum?id=ABcd123456#abstract", "ABcd123456"), ("/forum?id=ABcd123456&noteId=Z9", "ABcd123456"), ("ABcd123456/", "ABcd123456"), ("0171", "171"), ("#171", "171"), ("Paper 171", "171"), ("submission-171", "171"), ("Submission171", "171"), ("171\t", "171"), ("", None), ("  ", None), (None, None)],
)
def test_forum(spark, said, meant):
    assert one(spark, forum_of, said) == meant


@pytest.mark.parametrize(
    ("said", "meant"),
    [(" KVTPR.example / 2025/Conference/", "kvtpr.example/2025/conference"), ("K.EXAMPLE/2025/CONFERENCE/Withdrawn_Submission", "k.example/2025/conference"), ("k.example/2025/Conference/Poster", "k.example/2025/conference"), ("k/2025/Workshop/Oralia", "k/2025/workshop/oralia"), ("/", None), (None, None)],
)
def test_venue(spark, said, meant):
    assert one(spark, venue_of, said) == meant


def brute(rows, entities):
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(1, entities + 1):
        first = {}
        for r in rows:
            if r[0] is None or r[i] is None:
                continue
            a, b = root(first.setdefault(r[i], r[0])), root(r[0])
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{r.randrange(150):03d}", r.choice([None, "hot", *[f"a{i}" for i in range(60)]]) if r.random() > 0.3 else None, r.choice([None, *[f"s{i}" for i in range(90)]])) for _ in range(200)] + [(None, "hot", "s1")]
    df = spark.createDataFrame(rows, "id string, author string, source string").withColumn("component", F.lit("clash"))
    assert {x.id: x.component for x in entity_components(df, "id", ["author", "source"]).collect()} == brute(rows, 2)


def test_a_long_path_and_an_empty_table(spark):
    rows = [(f"n{i:04d}", f"e{i}") for i in range(300)] + [(f"n{i + 1:04d}", f"e{i}") for i in range(300)]
    got = entity_components(spark.createDataFrame(rows, "id string, e string"), "id", ["e"])
    assert {x.component for x in got.collect()} == {"n0000"}
    assert got.count() == 301
    assert entity_components(spark.createDataFrame([], "id string, e string"), "id", ["e"]).count() == 0


def test_shares_hold_with_a_giant(spark):
    rows = [(f"g{i:04d}", "giant") for i in range(1000)] + [(f"r{i:05d}", None) for i in range(2000)]
    made = assign_splits(entity_components(spark.createDataFrame(rows, "id string, e string"), "id", ["e"]), "id", dealt_share=0.05)
    n = {r.split: r["count"] for r in made.groupBy("split").count().collect()}
    assert abs(n["train"] / 3000 - 0.8) < 0.03 and abs(n["test"] / 3000 - 0.1) < 0.03
    assert made.groupBy("component").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
