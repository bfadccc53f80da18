import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ranking
from folioflow.llm.consensus import CUTOFF, RATINGS, score_of, spectral_reliability
from folioflow.llm.ranking import SELF, SMOOTHING, offence_defence, points_of
from folioflow.operators.sparse import Joined


@pytest.mark.parametrize(
    ("said", "points"),
    [("A", 1.0), ("Paper A", 1.0), (" a.", 1.0), ("candidate_a", 1.0), ("B ", 0.0), ("paper b", 0.0), ("tie", 0.5), ("A=B", 0.5), ("draw", 0.5), ("both?", None), ("C", None), ("", None), (None, None)],
)
def test_points(spark, said, points):
    assert spark.createDataFrame([(said,)], "w string").select(points_of(F.col("w")).alias("p")).first().p == points


def test_strengths_against_dense_iteration(spark):
    r = random.Random(7)
    games = [(f"i{a}", f"i{b}", r.choice([0.0, 0.5, 1.0])) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(150)) if a != b]
    games += [("i0", f"i{k}", 1.0) for k in range(1, 12)]
    extra = [("i0", None, 1.0), (None, "i1", 1.0), ("i1", "i1", 1.0), ("i2", "i3", None)]
    df = spark.createDataFrame(games + extra, "a string, b string, points double").withColumn("item", F.lit("clash"))
    got = {x.item: x.strength for x in offence_defence(df, tolerance=1e-9).collect()}
    n = 12
    won = np.zeros((n, n))  # won[q, p]: points p took from q
    for a, b, p in games:
        i, j = int(a[1:]), int(b[1:])
        won[j, i] += p + SMOOTHING
        won[i, j] += 1 - p + SMOOTHING
    won += SELF * np.eye(n)
    d = np.ones(n)
    for _ in range(500):
        o = (won / d[:, None]).sum(axis=0)
        d = (won / o[None, :]).sum(axis=1)
    want = np.log(o / d)
    want -= want.mean()
    assert all(abs(got[f"i{k}"] - want[k]) < 1e-6 for k in range(n))
    with pytest.raises(RuntimeError):
        offence_defence(df, rounds=2)


def test_ranking_is_fair_to_hard_opponents(spark):
    rows = [("strong", "weak", 1.0)] * 6 + [("middle", "weak", 1.0)] * 6 + [("strong", "middle", 1.0)] * 3 + [("strong", "new", 0.5)] * 2 + [("middle", "old", 0.5)] * 2
    got = {x.item: x.strength for x in offence_defence(spark.createDataFrame(rows, "a string, b string, points double")).collect()}
    assert got["strong"] > got["middle"] > got["weak"] and got["new"] > got["old"]


def test_no_games(spark):
    assert offence_defence(spark.createDataFrame([], "a string, b string, points double")).count() == 0


@pytest.mark.parametrize(("said", "level"), [("6: weak accept", 6.0), (" 10 ", 10.0), ("8/10", 8.0), ("[3]", 3.0), ("8.0", 8.0), ("Rating: 5", 5.0), ("7", None), ("no rating", None), ("", None), (None, None)])
def test_score(spark, said, level):
    assert spark.createDataFrame([(said,)], "r string").select(score_of(F.col("r"), RATINGS).alias("x")).first().x == level


def labelled(seed=1, items=120):
    r = random.Random(seed)
    quality = [r.gauss(0, 2) for _ in range(items)]
    rows = []
    for a in range(14):
        for i in r.sample(range(items), 40) if a else range(items):
            noise = r.gauss(0, 0.7)
            rows.append((f"p{i}", f"a{a}", {12: r.gauss(0, 2), 13: -quality[i] + noise}.get(a, quality[i] + a - 5 + noise)))
    return rows


def test_reliability_tells_random_and_reversed_annotators(spark):
    rows = labelled() + [("p1", "same", 3.0), ("p2", "same", 3.0), ("p3", None, 1.0), (None, "a1", 1.0), ("p4", "a1x", None), ("lonely", "hermit", 2.0)]
    df = spark.createDataFrame(rows, "item string, annotator string, rating double").withColumn("z", F.lit("clash"))
    got = {x.annotator: x.reliability for x in spectral_reliability(df)[1].collect()}
    assert all(got[f"a{k}"] > CUTOFF for k in range(12))
    assert abs(got["a12"]) < CUTOFF and got["a13"] < 0
    assert got["same"] == 0 and got["hermit"] == 0


def test_eigenvector_against_dense_matrix(spark):
    rows = labelled(4, 60)
    got = {x.annotator: x.reliability for x in spectral_reliability(spark.createDataFrame(rows, "item string, annotator string, rating double"), 1e-9)[1].collect()}
    items, annotators = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.full((len(annotators), len(items)), np.nan)
    for i, a, v in rows:
        x[annotators.index(a), items.index(i)] = v
    z = np.nan_to_num((x - np.nanmean(x, axis=1, keepdims=True)) / np.nanstd(x, axis=1, keepdims=True))
    m = (~np.isnan(x)).astype(float)
    agreement = z @ z.T
    np.fill_diagonal(agreement, 0)
    overlaps = m @ m.T
    np.fill_diagonal(overlaps, 0)
    values, vectors = np.linalg.eig(agreement / overlaps.sum(axis=1, keepdims=True))
    v = np.real(vectors[:, np.argmax(np.abs(values))])
    mine = np.array([got[a] for a in annotators])
    assert abs(np.corrcoef(v, mine)[0, 1]) > 0.9999


def test_no_labels(spark):
    weighted, judged = spectral_reliability(spark.createDataFrame([], "item string, annotator string, rating double"))
    assert weighted.count() == 0 and judged.count() == 0


def test_an_annotator_and_an_item_in_a_third_of_all_rows(spark, monkeypatch):
    """Salted and broadcast vectors give the same."""
    rows = labelled(6, 90) + [(f"p{i}", "busy", float(i % 7)) for i in range(90)] + [("p0", f"b{k}", float(k % 5)) for k in range(200)]
    games = [("hub", f"i{k}", [0.0, 0.5, 1.0][k % 3]) for k in range(60)] + [(f"i{k}", f"i{(k * 7 + 1) % 60}", 1.0) for k in range(60)]
    df, g = spark.createDataFrame(rows, "item string, annotator string, rating double"), spark.createDataFrame(games, "a string, b string, points double")
    one = {x.annotator: x.reliability for x in spectral_reliability(df)[1].collect()}, {x.item: x.strength for x in offence_defence(g).collect()}
    init = Joined.__init__
    monkeypatch.setattr(Joined, "__init__", lambda self, e, k, o, n: init(self, e, k, o, n, 0, 20))
    two = {x.annotator: x.reliability for x in spectral_reliability(df)[1].collect()}, {x.item: x.strength for x in offence_defence(g).collect()}
    for a, b in zip(one, two, strict=True):
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_the_games_stay_in_blocks_and_a_hub_is_in_many(spark, monkeypatch):
    """No round joins the games with a vector; many small blocks give what few give, and a third of all games is not one block."""
    games = [("hub", f"i{k % 300}", [0.0, 0.5, 1.0][k % 3]) for k in range(600)] + [(f"i{k % 300}", f"i{(k * 7 + 1 + k // 300) % 300}", float(k % 5 > 1)) for k in range(1200)]
    games = [g for g in games if g[0] != g[1]]
    df = spark.createDataFrame(games, "a string, b string, points double")
    one = {x.item: (x.strength, x.games) for x in offence_defence(df).collect()}
    monkeypatch.setattr(Joined, "with_vector", lambda *_: pytest.fail("the games met a vector in a join"))
    monkeypatch.setattr(ranking, "BLOCK_GAMES", 200)
    two = {x.item: (x.strength, x.games) for x in offence_defence(df).collect()}
    assert one.keys() == two.keys() and all(abs(one[k][0] - two[k][0]) < 1e-6 and one[k][1] == two[k][1] for k in one)
    sizes = [len(points) for _, _, _, points, _ in ranking.Grid.of(df, SMOOTHING).blocks.collect()]
    assert len(sizes) == 15 and sum(sizes) == len(games) and max(sizes) < len(games) / 5
