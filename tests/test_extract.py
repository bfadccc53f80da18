from pyspark.sql import functions as F

from folioflow.operators.extract import BUDGETS, chosen_sentences, evidence_fields, segments
from folioflow.operators.ranks import group_row_number, tile
from folioflow.plans import registry

MARKDOWN = """Title page, which counts for nothing at all here.

# Abstract
We propose a decoder for parsing. It is small and it is quick to train on plain machines.

## 2 Experiments
The dataset has many samples of text. The baseline is a planner of old. Nothing else is said of it.

# Conclusion
Results show that the decoder does outperform the baseline by far.

# References
[1] A reference that must not be read as evidence of anything.
"""


def test_segments(spark):
    text = "before any heading\n\n1. Introduction\nfirst lines of it\n\nsecond block\n2 Methods\nhow it is done\n\nabstract\nshort"
    rows = [(1, text), (2, ""), (3, None), (4, "no heading at all\n\nanother block")]
    got = {}
    for r in segments(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.paragraph_id, r.section))
    assert sorted(got) == [1, 4]
    assert sorted(got[4]) == [("section-01-p001", "Document"), ("section-01-p002", "Document")]
    assert sorted(got[1]) == [("section-01-p001", "Document"), ("section-02-p001", "1. Introduction"), ("section-02-p002", "1. Introduction"), ("section-03-p001", "2 Methods"), ("section-04-p001", "abstract")]


def test_evidence_fields(spark):
    # The words of a heading are whole words: "Experiments" is none of them, and all sections are read in its place.
    rows = [("a", MARKDOWN.replace("Experiments", "Experiment")), ("plural", MARKDOWN), ("b", ""), ("c", None), ("d", "text without any heading " * 20)]
    got = {r.id: r for r in evidence_fields(spark.createDataFrame(rows, "id string, md string"), "id", "md", dict.fromkeys(BUDGETS, 90)).collect()}
    assert sorted(got) == ["a", "b", "d", "plural"]
    a = got["a"]
    assert a.abstract.startswith("We propose") and a.experiment.startswith("The dataset") and "outperform" in a.finding
    assert all("reference that" not in x and "Title page" not in x for x in a[1:]) and all(len(x) <= 90 for x in a[1:])
    assert got["plural"].experiment.startswith("We propose") and "The dataset" in got["plural"].experiment
    assert got["b"][1:] == ("", "", "", "") and got["d"][1:] == ("", "", "", "")


def test_chosen_sentences(spark):
    text = "This is the first sentence here. This is the second sentence here. This is the third sentence here. We propose the fourth sentence here."
    rows = [("", ["x"], 50, ""), ("short text", ["x"], 5, "short"), (text, ["we propose"], 36, "We propose the fourth sentence here."), ("x" * 1000 + " yes", [], 100, "x" * 100)]
    for said, words, budget, want in rows:
        assert spark.createDataFrame([(said,)], "t string").select(chosen_sentences(F.col("t"), words, budget).alias("c")).first().c == want


def test_group_numbers_with_a_hot_group(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, 1), (None, 2), ("b", 7)]
    got = group_row_number(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.desc("v")], "n", "size").collect()
    assert all(r.n == 3000 - r.v and r["size"] == 3000 for r in got if r.g == "hot")
    assert sorted((r.v, r.n) for r in got if r.g is None) == [(1, 2), (2, 1)]


def test_tiles(spark):
    for n in (1, 2, 3, 7, 10):
        t = spark.range(1, n + 1).select("id", tile(F.col("id"), F.lit(n), 3).alias("t"))
        want = spark.sql(f"select id, ntile(3) over (order by id) as t from range(1, {n + 1})")
        assert sorted(map(tuple, t.collect())) == sorted(map(tuple, want.collect()))


def test_abstract_or_the_whole_text(spark, tmp_path):
    texts = {"a": "# Title\n## Abstract\nshort  text\nof it\n# Intro\nrest", "b": "no heading\n\n of  that kind ", "c": "# Abstract\n", "d": "x" * 2000, "e": "", "f": None}
    spark.createDataFrame([(k, (v,)) for k, v in texts.items()], "paper_id string, markdown struct<content: string>").write.parquet(f"{tmp_path}/proreview.parquet")
    got = {r.paper_id: r.abstract for r in registry.queries()["t06_abstract"](spark, str(tmp_path)).collect()}
    assert got == {"a": "short text of it", "b": "no heading of that kind", "c": "", "d": "x" * 1024, "e": ""}


def test_long_texts_and_blocks_are_kept_whole(spark):
    long = "word " * 5_000 + "end"
    df = spark.createDataFrame([(1, "\n\n".join([long] * 9 + ["last"]))], "id int, text string")
    assert [r.text for r in segments(df, "id", "text").orderBy("paragraph_id").collect()] == [long] * 9 + ["last"]
    cut = segments(df, "id", "text", 200_000, 20_000).orderBy("paragraph_id").collect()
    assert len(cut) == 8 and max(len(r.text) for r in cut) == 20_000
