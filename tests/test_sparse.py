import random

from pyspark.sql import functions as F

from folioflow.operators.sparse import Joined


def test_a_key_in_a_third_of_all_rows(spark):
    r = random.Random(1)
    rows = [(0 if r.random() < 1 / 3 else r.randrange(1, 500), i, float(i % 7)) for i in range(30_000)] + [(None, 1, 1.0)]
    entries = spark.createDataFrame(rows, "k int, other int, x double").repartition(4)
    vector = spark.createDataFrame([(k, k / 10) for k in range(400)], "k int, v double")
    want = sorted((o, x * (k / 10)) for k, o, x in rows if k is not None and k < 400)
    for most, hot in ((1000, 100), (10, 500), (10, 10**6)):
        joined = Joined(entries, "k", "other", 400, most, hot)
        assert (joined.hot is not None) == (hot == 500)
        got = joined.with_vector(vector)
        assert sorted((a.other, a.y) for a in got.select("other", (F.col("x") * F.col("v")).alias("y")).collect()) == want
        assert "_salt" not in got.columns
    # The hot key's rows lie under as many salts as its share asks for, none with more than twice the others.
    salted = Joined(entries, "k", "other", 400, 10, 500).entries.filter("k = 0").groupBy("_salt").count()
    sizes = [x["count"] for x in salted.collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, other int")
    assert Joined(none, "k", "other", 0).with_vector(none.select("k")).count() == 0
    assert Joined(none, "k", "other", 5, 1).with_vector(none.select("k")).count() == 0
