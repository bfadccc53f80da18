import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.garbled import fit, garbled

LINES = {
    "fr": "Nous étudions la sélection de manuscrits et présentons une méthode légère à côté de la référence évaluée.",
    "de": "Für die Prüfung wurden Datensätze von zwei unabhängigen Fachkräften geprüft, während die Größe unverändert bleibt.",
    "pt": "A avaliação de articulações não exige soluções já conhecidas, e a comparação é útil às regiões.",
    "ru": "Рецензент отмечает, что метод не сравнивался с классическими решениями, подходящими под прогноз урожая.",
    "zh": "论文写作清晰，采用混合聚合模块处理天文中的信息抽取是合理的选择，附录中的案例也有帮助。",
    "en": "The reviewers’ request was met – a résumé of all “naïve” runs is in § 4, as Müllenhart and Škrlinec report.",
}
WRONG = [("fr", "utf-8", "cp1252"), ("fr", "utf-8", "iso8859-1"), ("de", "utf-8", "cp850"), ("de", "utf-8", "mac-roman"), ("pt", "utf-8", "cp1251"), ("ru", "cp1251", "iso8859-1"), ("ru", "koi8-r", "cp1251"), ("ru", "utf-8", "cp1251"), ("zh", "gbk", "iso8859-1"), ("zh", "utf-8", "gb18030"), ("en", "utf-8", "cp1252"), ("fr", "cp1252", "utf-8"), ("fr", "cp1252", "mac-roman")]


def corpus():
    r = random.Random(1)
    rows, i = [], 0
    for _ in range(40):
        for t in LINES.values():
            w = t.split(" ")
            rows.append((i, " ".join(w) if r.random() < 0.5 else " ".join(w[r.randrange(len(w)) :]) or t))
            i += 1
    originals = {}
    for k, (language, right, wrong) in enumerate(WRONG):
        t = LINES[language]
        bad = t.encode(right).decode(wrong, "replace")
        sound = LINES["en"] + "\n\n"
        rows.append((10_000 + k, sound + bad))
        originals[10_000 + k] = sound + t
    twice = LINES["fr"].encode().decode("cp1252", "replace")
    if "�" not in twice:
        rows.append((11_000, twice.encode().decode("iso8859-1")))
        originals[11_000] = LINES["fr"]
    return rows, originals


@pytest.fixture(scope="module")
def result(spark):
    rows, originals = corpus()
    rows += [(None, rows[-1][1]), (20_000, None), (20_001, ""), (20_002, "plain ascii text"), (20_003, "x" * 300_000 + " é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash"))
    return {x.doc_id: x for x in garbled(df).collect()}, originals


def test_found_and_no_other(result):
    got, originals = result
    assert set(got) == set(originals)


def test_originals_where_no_byte_is_lost(result):
    got, originals = result
    lost = [10_000 + k for k, (language, right, wrong) in enumerate(WRONG) if "�" in LINES[language].encode(right).decode(wrong, "replace")]
    exact = [i for i in originals if i not in lost]
    assert sum(got[i].original == originals[i] for i in exact) >= 0.9 * len(exact)


def test_lost_bytes_are_filled_in_by_the_words(result):
    got, originals = result
    k = 10_000 + WRONG.index(("fr", "cp1252", "utf-8"))
    restored = got[k].restored.split()
    assert sum(a == b for a, b in zip(restored, originals[k].split(), strict=False)) > 0.9 * len(restored)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert garbled(none).count() == 0 and fit(none).words == {}
