import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.packing import VOCABULARY, Plan, _encoding, packed, token_pieces


def least_containers(sizes, capacity):
    """The lower bound L2 of Martello and Toth: large items can't share, whatever is done."""
    best = -(-sum(sizes) // capacity)
    for k in range(capacity // 2 + 1):
        large = [s for s in sizes if s > capacity - k]
        half = [s for s in sizes if capacity / 2 < s <= capacity - k]
        small = [s for s in sizes if k <= s <= capacity / 2]
        room = len(half) * capacity - sum(half)
        best = max(best, len(large) + len(half) + max(0, -(-(sum(small) - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once_and_fits(seed):
    r = random.Random(seed)
    histogram = {n: r.randrange(1, 30) for n in r.sample(range(1, 101), 60)}
    plan = Plan(dict(histogram), 100)
    used = {}
    for combination, times in plan.patterns:
        assert sum(combination) <= 100 and times > 0
        for n in combination:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    containers = sum(t for _, t in plan.patterns)
    least = least_containers([n for n, c in histogram.items() for _ in range(c)], 100)
    assert containers <= 1.02 * least + 1


def test_exact_complements():
    assert Plan({60: 1, 25: 1, 15: 1, 50: 1}, 100).patterns[0] == ((60, 25, 15), 1)
    assert Plan({}, 10).patterns == []
    assert Plan({10: 5}, 10).patterns == [((10,), 5)]
    assert Plan({6: 3}, 10).patterns == [((6,), 3)]


def test_packing_with_a_hot_length(spark):
    r = random.Random(2)
    rows = [(i, 0, 7) for i in range(3000)] + [(10_000 + i, 0, r.randrange(0, 51)) for i in range(3000)] + [(7, 0, 7), (None, 0, 7), (1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, tokens int").withColumn("n", F.lit("clash"))
    got = packed(df, 50).cache()
    assert got.count() == len(rows) - 1
    per = got.groupBy("sequence").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.countDistinct("position").alias("p")).collect()
    assert all(x.t <= 50 and x.n == x.p for x in per)
    assert len(per) <= 1.01 * least_containers([x[2] for x in rows if x[2]], 50) + 1
    with pytest.raises(ValueError):
        packed(df, 40)
    assert packed(df.limit(0), 50).count() == 0


def test_token_pieces(spark):
    encoding = _encoding(VOCABULARY)
    texts = [(1, "A short text, 数据 and émoji 🙂."), (2, ""), (3, None), (4, "word " * 5000), (4, "word " * 5000)]
    got = token_pieces(spark.createDataFrame(texts, "doc_id bigint, text string"), 1600).collect()
    n = len(encoding.encode_ordinary(texts[3][1]))
    assert sum(x.tokens for x in got if x.doc_id == 4) == 2 * n
    assert sorted(x.first_token for x in got if x.doc_id == 4) == sorted([k * 1600 for k in range(-(-n // 1600))] * 2)
    assert [x.tokens for x in got if x.doc_id == 1] == [len(encoding.encode_ordinary(texts[0][1]))]
    assert [(x.doc_id, x.tokens) for x in got if x.doc_id in (2, 3)] == [(2, 0)]
