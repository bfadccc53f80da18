import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import leaks as L
from folioflow.llm.leaks import Index, leaks, longest_run, tokens

WORDS = [a + b for a in "ba de ki lo mu na pe ri so tu va zi".split() for b in "ran tel mok sid fun ger lap nov".split()]
CHARACTERS = "数据模型训练样本分析方法结果实验评审论文研究系统网络优化估计检测分割聚类推理预测校准稀疏鲁棒隐变量图像语音"


def items(r):
    return [(i, " ".join(r.choice(WORDS) for _ in range(80)) + ".") for i in range(12)] + [(50, "".join(r.choice(CHARACTERS) for _ in range(120)))]


def corpus(r, things):
    said = dict(things)
    docs, want = [], set()

    def noise(n):
        return " ".join(r.choice(WORDS) for _ in range(n))

    for i in range(60):
        docs.append((i, noise(r.randrange(0, 300))))
    for k in range(12):
        w = said[k].split()
        part = w[10:48]
        part[9], part[22] = part[9].upper() + ",", "**changed**"
        docs.append((100 + k, noise(70) + "\n" + "\n".join(" ".join(part[i : i + 7]) for i in range(0, len(part), 7)) + "\n" + noise(50)))
        want.add((100 + k, k))
        docs.append((200 + k, noise(60) + " " + " ".join(w[5:27]) + " " + noise(40)))
        docs.append((300 + k, " ".join(x if i % 3 else "x" + x for i, x in enumerate(w))))
    docs.append((400, noise(20) + said[50][30:95] + noise(20)))
    want.add((400, 50))
    docs.append((401, said[50][30:70]))
    return docs, want


def brute(docs, things):
    index = Index([(i, tokens(t)) for i, t in things])
    out = set()
    for d, t in docs:
        if d is None or not t:
            continue
        toks = index._numbers([tokens(t)]).tolist()
        for i in range(len(things)):
            n = longest_run(toks, index, i, 0, len(toks))
            if n >= (L.LEAST_CHARACTERS if index.chinese[i] else L.LEAST_WORDS):
                out.add((d, int(index.ids[i])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_leaks_and_all_pairs(spark, seed):
    r = random.Random(seed)
    things = items(r)
    docs, want = corpus(r, things)
    docs += [(None, things[0][1]), (999, None), (998, ""), docs[60]]
    assert brute(docs, things) == want
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    held = spark.createDataFrame([*things, things[0], (None, "x"), (77, None), (78, "too short")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leaks(df, held).collect()} == want
    # Several indexes give the same.
    assert {(x.doc_id, x.item_id) for x in leaks(df, held, 300).collect()} == want


def test_same_ids_with_other_texts(spark):
    r = random.Random(9)
    for _ in range(2):
        things = items(r)
        docs, want = corpus(r, things)
        got = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(things, "item_id bigint, text string"))
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_a_sentence_after_the_same_pattern_is_no_leak():
    r = random.Random(4)
    pattern = "sensitivity to the {} is small since the {} of all {} varies by {} percent when the {} is rescaled and the {} of the remaining {} systems is kept as it was before the {} stage began for the {} users"
    things = [(i, pattern.format(*[r.choice(WORDS) + r.choice(WORDS) for _ in range(9)])) for i in range(40)]
    other = pattern.format(*[r.choice(WORDS) + r.choice(WORDS) for _ in range(9)])
    assert brute([(1, other)], things) == set()
    assert brute([(1, things[7][1])], things) == {(1, 7)}


def test_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leaks(docs, none).count() == 0
    assert leaks(docs.limit(0), spark.createDataFrame([(1, "word " * 50)], "item_id bigint, text string")).count() == 0


def test_tokens():
    assert tokens("A <b>label-\nfree</b> *test* of 8.95% ｗｏｒｄｓ") == ["a", "labelfree", "test", "of", "895", "words"]
    assert tokens("") == []


def test_more_different_words_than_fit_into_one_key():
    """Every run of every item is found again among 64,000 different words."""
    letters = "bcdfghjklmnprstvwxyz"
    words = ["".join(x) for x in itertools.product(letters, "aeiou", letters, "aeiou", letters[:8])]
    things = [(j, words[j * 64 : (j + 1) * 64]) for j in range(1000)] + [(5000, list(CHARACTERS))]
    index = Index(things)
    assert len(index.number) > 60_000
    # No word stands twice, so that every term is another.
    assert len(set(index.key_at[index.has_key].tolist())) == sum(len(x) - 2 for _, x in things)
    docs = [words[j * 64 + 8 : j * 64 + 40] for j in range(1000)]
    found, _ = index.regions(docs)
    assert {(d, int(index.ids[i])) for d, i in found} == {(j, j) for j in range(1000)}
    assert index.regions([words[3:4000:64]])[0] == {}


def test_no_passage_that_an_alignment_accepts_is_lost():
    """One word in seven changed, added or dropped, at random: all-pairs alignment against the search."""
    r = random.Random(3)
    things = [(i, [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(30, 90))]) for i in range(60)]
    index, docs = Index(things), []
    for _ in range(400):
        _, item = r.choice(things)
        a = r.randrange(0, len(item) - 29)
        part, out = item[a : a + r.randrange(30, 70)], []
        for w in part:
            kind = r.random() * 7
            out += [w] if kind > 1 else [r.choice(WORDS)] if kind < 0.6 else [w, r.choice(WORDS)] if kind < 0.8 else []
        docs.append([r.choice(WORDS) for _ in range(r.randrange(200))] + out + [r.choice(WORDS) for _ in range(50)])
    numbers = [index._numbers([d]).tolist() for d in docs]
    want = {(d, i) for d, x in enumerate(numbers) for i in range(len(things)) if longest_run(x, index, i, 0, len(x)) >= L.LEAST_WORDS}
    found, _ = index.regions(docs)
    got = {(d, i) for (d, i), (lo, hi) in found.items() if longest_run(numbers[d], index, i, lo - L.GAP, hi + L.GAP) >= L.LEAST_WORDS}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)
