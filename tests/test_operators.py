import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import hashing, numbers, text
from folioflow.operators import calibration, dedup, fusion, labels, metrics, sampling, similarity, validation
from folioflow.operators.components import connected_components
from folioflow.operators.ranks import average_ranks, evenly_spaced, global_row_number, running_totals
from folioflow.operators.scoring import SCORERS, close_json, parses, score


def scored(seed=1, n=400, coarse=5):
    r = random.Random(seed)
    return [(i, r.choice([0, 0, 1, None]), round(r.random() * coarse) / coarse if r.random() > 0.05 else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, y int, s double")


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(0, 1), (0, 1), (5, 5), (None, 3)] + [(7, i) for i in range(100, 160)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_row_numbers_and_running_totals(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {x.id: x.row_number for x in global_row_number(df, [F.desc("v"), F.col("id")], partitions=7).collect()}
    assert [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))
    totals = {x.v: (x.id, x.id_before) for x in running_totals(df, "v", ["id"], partitions=7).collect()}
    for v, (at, before) in totals.items():
        assert at == sum(i for i, w in rows if w == v) and before == sum(i for i, w in rows if w < v)
    assert global_row_number(df.limit(0), [F.col("v")]).count() == 0 and running_totals(df.limit(0), "v", ["id"]).count() == 0


def test_average_ranks(spark):
    got = {x.id: x.rank for x in average_ranks(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "id int, v double"), "v").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 0.0, 4: None, 5: 3.0}


def test_auc_and_average_precision_against_all_pairs(spark):
    rows = scored()
    pos, neg = [s for _, y, s in rows if y == 1 and s is not None], [s for _, y, s in rows if y == 0 and s is not None]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(frame(spark, rows), "y", "s").first().auc - auc) < 1e-9
    ap, before = 0.0, 0
    for t in sorted({*pos, *neg}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(x >= t for x in pos + neg)
        ap, before = ap + (tp - before) / len(pos) * tp / n, tp
    assert abs(metrics.average_precision(frame(spark, rows), "y", "s").first().average_precision - ap) < 1e-9
    assert metrics.auc(frame(spark, [(1, 1, 0.5)]), "y", "s").first().auc is None
    assert metrics.auc(frame(spark, []), "y", "s").first().auc is None


def test_threshold_sweep(spark):
    rows = scored(3)
    known = [(y, s) for _, y, s in rows if y is not None and s is not None]
    best = {}
    for t in [math.inf, *sorted({s for _, s in known}, reverse=True)]:
        tp, fp, p = sum(y == 1 and s >= t for y, s in known), sum(y == 0 and s >= t for y, s in known), sum(y for y, _ in known)
        row = {"f1": 2 * tp / (tp + fp + p), "accuracy": (tp + len(known) - p - fp) / len(known)}
        for g in row:
            if g not in best or row[g] > best[g][0] + 1e-12:
                best[g] = (row[g], t)
    got = {x.goal: (x[x.goal], x.threshold) for x in metrics.threshold_sweep(frame(spark, rows), "y", "s").collect()}
    assert all(abs(got[g][0] - best[g][0]) < 1e-9 and got[g][1] == best[g][1] for g in best)
    assert metrics.threshold_sweep(frame(spark, []), "y", "s").count() == 0


def test_ndcg_with_ties(spark):
    rows = [(i, random.Random(i).randrange(5), float(random.Random(i + 99).randrange(4))) for i in range(60)]
    groups = sorted({s for *_, s in rows}, reverse=True)

    def dcg(by):
        at, total = 0, 0.0
        for t in sorted({by(x) for x in rows}, reverse=True):
            tied = [x[1] for x in rows if by(x) == t]
            total += sum(sum(tied) / len(tied) / math.log2(i + 2) for i in range(at, min(at + len(tied), 20)))
            at += len(tied)
        return total

    want = dcg(lambda x: x[2]) / dcg(lambda x: x[1])
    assert groups and abs(metrics.ndcg(frame(spark, rows), "y", "s").first().ndcg - want) < 1e-9


def test_concordance_against_all_pairs(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), r.choice([1, 2, 3, None]), r.choice([0.1, 0.2, 0.3, 0.4])) for _ in range(300)]
    want = {}
    for i, (g, t, s) in enumerate(rows):
        for g2, t2, s2 in rows[:i]:
            if g == g2 and t is not None and t2 is not None and t != t2:
                w = want.setdefault(g, [0, 0, 0, 0])
                w[0] += 1
                w[3 if s == s2 else 1 if (s > s2) == (t > t2) else 2] += 1
    got = {x.g: [x.pairs, x.right, x.wrong, x.ties] for x in metrics.concordance(spark.createDataFrame(rows, "g string, t int, s double"), ["g"], "t", "s").collect()}
    assert got == want
    assert metrics.concordance(spark.createDataFrame([], "g string, t int, s double"), ["g"], "t", "s").count() == 0


def test_spearman_and_constant_side(spark):
    rows = [(i, i % 7, float(i % 5)) for i in range(70)] + [(99, None, 1.0)]
    got = metrics.spearman(frame(spark, rows), "y", "s").first()
    rank = lambda v: np.array([np.mean([sorted(v).index(x), len(v) - 1 - sorted(v)[::-1].index(x)]) for x in v])
    assert got.n == 70 and abs(got.spearman - np.corrcoef(rank([x[1] for x in rows[:70]]), rank([x[2] for x in rows[:70]]))[0, 1]) < 1e-9
    assert metrics.pearson(frame(spark, [(1, 1, 2.0), (2, 1, 3.0)]), "y", "s").first().pearson == 0


def test_probabilities_and_bins(spark):
    rows = [(1, 1, 1.0), (2, 0, 0.0), (3, 1, 0.5), (4, None, 0.4), (5, 0, 0.25)]
    m = metrics.probability_metrics(frame(spark, rows), "y", "s").first()
    assert m.n == 4 and abs(m.brier - (0.25 + 0.0625) / 4) < 1e-9 and m.accuracy == 1.0
    assert {x.bin for x in metrics.calibration_bins(frame(spark, rows), "y", "s").collect()} == {0, 2, 5, 9}


def test_bootstrap_is_the_same_however_the_rows_lie(spark):
    rows = [(float(i % 3 == 0), float(i % 4 == 0)) for i in range(400)]
    one = metrics.paired_bootstrap(spark.createDataFrame(rows, "a double, b double").repartition(1), "a", "b", 200).first()
    two = metrics.paired_bootstrap(spark.createDataFrame(rows[::-1], "a double, b double").repartition(5), "a", "b", 200).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip(one, two, strict=True)) and one.low < one.difference < one.high


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    sets = {tuple(sorted(r.sample(words, r.randrange(1, 9)))) for _ in range(60)}
    sets |= {tuple(sorted(set(s) ^ {r.choice(words)})) for s in list(sets)}
    rows = [(i, list(s)) for i, s in enumerate(sorted(x for x in sets if x))] + [(9999, [])]
    for threshold, head in ((0.6, None), (0.8, 3)):
        want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold - 1e-12 and (head is None or {*x[:head]} & {*y[:head]})}
        got = {(x.a, x.b) for x in dedup.jaccard_links(spark.createDataFrame(rows, "id int, tokens array<string>"), threshold, head).collect()}
        assert got == want and want


def test_groups_splits_and_nulls(spark):
    rows = [(1, "x", ["a", "b"]), (2, "x", ["c"]), (3, None, ["c"]), (4, "", []), (5, None, None), (None, "x", ["a"])]
    got = {x.id: x.group for x in dedup.duplicate_groups(spark.createDataFrame(rows, "id int, v string, t array<string>"), "id", ["v"], "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    exact = {x.id: (x.group, x["size"]) for x in dedup.exact_groups(spark.createDataFrame(rows, "id int, v string, t array<string>"), "id", "v").collect()}
    assert exact == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)} or exact[1] == (1, 3)
    members = spark.createDataFrame([(i, i // 3, "test" if i == 4 else None) for i in range(3000)], "id int, group int, split string")
    split = dedup.split_groups(members, "id", "group", "split", "s").cache()
    assert split.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {x.split for x in split.filter("id in (3, 4, 5)").collect()} == {"test"}
    assert 0.06 < split.filter("split = 'validation'").count() / 3000 < 0.14


def test_tfidf_and_cosine(spark):
    docs = {1: ["a", "a", "b"], 2: ["a", "c"], 3: [], 4: ["b", "b", "a", "a"]}
    df = spark.createDataFrame(list(docs.items()), "id int, terms array<string>")
    v = similarity.tfidf(df).cache()
    n, freq = 4, {"a": 3, "b": 2, "c": 1}
    vec = {i: {t: (1 + math.log(x.count(t))) * (math.log((n + 1) / (freq[t] + 1)) + 1) for t in set(x)} for i, x in docs.items()}
    norm = {i: math.sqrt(sum(w * w for w in x.values())) for i, x in vec.items()}
    got = {(x.query, x.id): x.cosine for x in similarity.cosines(v, v).collect()}
    for (a, b), c in got.items():
        assert abs(c - sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) / norm[a] / norm[b]) < 1e-9
    best = similarity.best_match(spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.5), (2, 7, 0.6), (2, 9, 0.6), (3, 7, 0.1)], "q int, o int, s double"), "q", "o", "s", 0.3, 0.1)
    assert {(x.q, x.o) for x in best.collect()} == {(1, 7)}


def test_fusion_and_agreement(spark):
    hits = spark.createDataFrame([("p", "q1", 0, 1.0), ("p", "q2", 1, 3.0), ("o", "q1", 1, 2.0), (None, "q1", 2, 9.0)], "item string, query string, rank int, rel double")
    got = {x.item: (x.hits, x.queries, round(x.rrf, 6), x.relevance) for x in fusion.reciprocal_rank_fusion(hits, "item", "query", "rank", "rel").collect()}
    assert got == {"p": (2, 2, 1.5, 3.0), "o": (1, 1, 0.5, 2.0)}
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "z", 2)], "batch int, item string, rank int")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 0), (1, "z", 2)], "batch int, item string, rank int")
    assert tuple(fusion.order_agreement(a, b, "batch", "item", "rank").first())[:2] == (3, 2)
    assert {x.item: x.rank_sum for x in fusion.borda(a, b, "batch", "item", "rank").collect()} == {"x": 1, "y": 1, "z": 4}


def test_labels(spark):
    rows = [("a", [8.0, 6.0], [3.0, 1.0], 1.0), ("b", [8.0, 6.0], [3.0], 1.0), ("c", [], [], 4.0), ("d", None, None, None), ("e", [5.0, 7.0], [0.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "id string, r array<double>, c array<double>, s double")
    assert {x.id: x.w for x in df.select("id", labels.weighted_rating(F.col("r"), F.col("c"), F.col("s")).alias("w")).collect()} == {"a": 7.5, "b": 7.0, "c": 4.0, "d": None, "e": 6.0}
    reviews = spark.createDataFrame([("p", 1.0, 1.0), ("p", 10.0, 5.0), ("q", 5.0, 3.0), ("r", None, 2.0)], "p string, r double, c double")
    got = {x.p: x.label for x in labels.precision_weighted(reviews, "p", "r", "c").collect()}
    assert got["p"] > 0.9 and abs(got["q"] - 4 / 9) < 1e-9 and "r" not in got


def test_calibration(spark):
    ref = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4, 9)], "r double")
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 9.0), (4, 20.0), (5, None)], "id int, v double")
    got = {x.id: x.percentile for x in calibration.mid_rank_percentile(df, "v", ref, "r").collect()}
    assert got == {1: 0.0, 2: 37.5, 3: 100.0, 4: 100.0, 5: None}
    assert calibration.mid_rank_percentile(df, "v", ref.limit(1), "r").filter("id = 1").first().percentile == 50.0
    assert calibration.mid_rank_percentile(df, "v", ref.limit(0), "r").filter("id = 1").first().percentile is None
    rows = [(i, i % 2, (i % 2) * 2.0 - 1 + random.Random(i).gauss(0, 0.5)) for i in range(200)]
    z = frame(spark, rows)
    w, b = calibration.logistic_regression(z, ["s"], "y", l2=1e-3)
    p = z.withColumn("p", numbers.sigmoid(calibration.linear(["s"], w, b)))
    assert metrics.auc(p, "y", "p").first().auc > 0.95 and w[0] > 0
    assert calibration.logistic_regression(frame(spark, []), ["s"], "y")[0] == [0.0]


def test_sampling(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(300)], "id int, g int, v double")
    top = sampling.top_per_group(df, ["g"], [F.desc("v")], 2)
    assert sorted(x.id for x in top.collect()) == [294, 295, 296, 297, 298, 299]
    quota = sampling.stratified_quota(df, ["g"], "id", {("0",): 5, ("1",): 200}, "s", F.col("id") == 3)
    n = {x.g: x["count"] for x in quota.groupBy("g").count().collect()}
    assert n == {0: 5, 1: 100} and quota.filter("id = 3").count() == 1
    bands = [x.g for x in sampling.band_diverse(df, "g", [F.desc("v")], 4).collect()]
    assert sorted(bands[:3]) == [0, 1, 2] and len(bands) == 4
    even = [x.id for x in evenly_spaced(df, [F.col("id")], 4).orderBy("sample_no").collect()]
    assert even == [0, 100, 199, 299] and evenly_spaced(df, [F.col("id")], 1).first().id == 150
    assert evenly_spaced(df.limit(2), [F.col("id")], 5).count() == 5 and evenly_spaced(df.limit(0), [F.col("id")], 5).count() == 0


def test_validation(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (1, 5)], "id int, v int")
    bad = {(x.key, x.message) for x in validation.violations(df, "id", {"positive": F.col("v") > 0}).collect()}
    assert bad == {("2", "positive"), ("3", "positive")}
    assert [x.key for x in validation.repeated_keys(df, "id").collect()] == ["1"]
    target = spark.createDataFrame([(1,), (2,)], "k int")
    assert [x.key for x in validation.missing_references(df, "id", target, "k").collect()] == ["3"]
    train = spark.createDataFrame([(1, "a", None), (2, "", "x"), (3, "b", "y"), (4, None, None)], "id int, k string, m string")
    test = spark.createDataFrame([("a", "y"), ("", "q"), (None, None)], "k string, m string")
    keys = [F.col("k"), F.col("m")]
    assert sorted(x.id for x in validation.without_overlap(train, test, keys).collect()) == [2, 4]
    assert sorted(x.id for x in validation.without_overlap(train, test, keys, empty_matches=True).collect()) == [4]
    assert sorted(x.id for x in validation.overlapping(train, test, keys).collect()) == [1, 3]


@pytest.mark.parametrize(
    ("cut", "closed"),
    [('{"a": [1, {"b": "x', '{"a": [1, {"b": "x"}]}'), ('{"a": 1}', '{"a": 1}'), ('x {"a": "q\\', '{"a": "q"}'), ('{"a": "b",', '{"a": "b"}'), ("no brace", None), (None, None), ('{"a": 1} tail', '{"a": 1}')],
)
def test_close_json(cut, closed):
    assert close_json(cut) == closed and (closed is None or parses(closed))


def test_scorers(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    assert {x.id: x.score for x in score(df, "id", "t", "length").collect()} == {1: 3.0, 2: 0.0}
    mock = df.filter("id = 1").select(hashing.mock_score(F.col("t")).alias("s")).first().s
    assert score(df.filter("id = 1"), "id", "t", "mock").first().score == mock
    with pytest.raises(KeyError):
        score(df, "id", "t", "none")
    assert set(SCORERS) >= {"mock", "length"}


def test_text_edge_cases(spark):
    values = [None, "", " ", "x" * 100_000, "Ünïcode 漢字 ＡＢ", "a\r\n\r\n\r\n\r\nb  \n", "mail me@x.org or https://a.b/profile?id=~Jo_Li1 ~Jo_Li1 0000-0001-2345-678X"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    c = F.col("t")
    out = {r.id: r for r in df.select("id", text.clean_text(c).alias("clean"), text.redact(c).alias("redacted"), text.title_key(c).alias("key"), text.word_count(c).alias("words"), text.nfkc(c).alias("nfkc"), text.sentences(c).alias("s"), text.list_items(c).alias("i"), text.string_list(c).alias("l"), text.head_and_tail(c, 10).alias("h"), text.slug(c).alias("slug"), text.reference_count(c).alias("refs")).collect()}
    assert out[0].clean is None and out[1].clean == "" and out[5].clean == "a\n\nb" and out[4].nfkc == "Ünïcode 漢字 AB" and out[4].words == 6 or out[4].words > 2
    assert out[6].redacted == "mail [REDACTED_EMAIL] or [REDACTED_PROFILE] [REDACTED_PROFILE] [REDACTED_ORCID]"
    assert out[3].h == "xxxxx\n[...]\nxxxxx" and len(out[2].slug) == 12
    names = spark.createDataFrame([("By JANE (Doe) and jane (doe)", ["Jane (Doe)", "abc", None])], "t string, n array<string>")
    assert names.select(text.redact_terms(F.col("t"), F.col("n")).alias("x")).first().x == "By [REDACTED_AUTHOR] and [REDACTED_AUTHOR]"
    lists = spark.createDataFrame([("- first item here\n- second item here\n",), ("block one text\n\nblock two text",)], "t string").select(text.list_items(F.col("t")).alias("x")).collect()
    assert lists[0].x == ["first item here", "second item here"] and lists[1].x == ["block one text", "block two text"]
    assert spark.createDataFrame([("a; b,c ,1,2；d\n",)], "t string").select(text.string_list(F.col("t")).alias("x")).first().x == ["a", "b", "c ,1,2".strip(), "d"]


def test_number_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 5.0), (4, -1e9), (5, 1e9)], "id int, v double")
    got = {x.id: (x.c, x.s) for x in df.select("id", numbers.clamp(F.col("v"), 0, 10).alias("c"), numbers.sigmoid(F.col("v")).alias("s")).collect()}
    assert got[1][0] == 0 and got[2][0] == 0 and got[3][0] == 5 and got[5] == (10.0, 1.0) and got[4][1] < 1e-300
    w = spark.range(1).select(*[x.alias(f"w{i}") for i, x in enumerate((*numbers.wilson(F.lit(0), F.lit(0)), *numbers.wilson(F.lit(5), F.lit(10))))]).first()
    assert w.w0 is None and abs(w.w2 - 0.2366) < 1e-3 and abs(w.w3 - 0.7634) < 1e-3
    m = spark.range(1).select(numbers.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("a"), numbers.min_max(F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("b"), numbers.min_max(F.lit(2.0), F.lit(1.0), F.lit(3.0), 1e-8).alias("c")).first()
    assert m.a == 0 and m.b == 0.5 and abs(m.c - 0.5) < 1e-6


def test_stable_units(spark):
    df = spark.range(4000).select(hashing.stable_unit(F.col("id").cast("string"), "s").alias("u"), hashing.stable_unit(F.col("id").cast("string"), "s", True).alias("p"), hashing.ratio_unit(F.col("id").cast("string"), "s").alias("r"))
    got = df.agg(F.max("u").alias("u"), F.max("p").alias("p"), F.avg((F.col("r") < 0.1).cast("int")).alias("r"), F.avg((F.col("u") < 0.1).cast("int")).alias("s")).first()
    assert got.u > 0.99 and got.p < 0.5 and 0.08 < got.r < 0.12 and 0.08 < got.s < 0.12
