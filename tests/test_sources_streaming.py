import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.sources import files, paged
from folioflow.sources.tables import pruned_table
from folioflow.streaming import incremental

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def test_jsonl(spark, tmp_path):
    rows = [(1, "a", ["x"]), (2, None, None), (3, 'q"uote\n', [])]
    df = spark.createDataFrame(rows, SCHEMA)
    files.write_jsonl(df, f"{tmp_path}/a.jsonl")
    assert sorted(map(tuple, files.read_any(spark, f"{tmp_path}/a.jsonl", SCHEMA).collect())) == rows
    with pytest.raises(PySparkException):
        files.write_jsonl(df, f"{tmp_path}/a.jsonl")
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": "x"\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", SCHEMA).collect()
    assert [x.line for x in files.bad_lines(spark, f"{tmp_path}/bad.jsonl", SCHEMA).collect()] == ['{"id": "x"']
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl", SCHEMA, missing_is_empty=True).count() == 0
    with pytest.raises(PySparkException):
        files.read_jsonl(spark, f"{tmp_path}/none.jsonl", SCHEMA).count()


def test_csv_lines_and_digests(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"say ""hi"",\nthere"\n2,\n')
    t = files.read_csv(spark, f"{tmp_path}/a.csv", T.StructType.fromDDL("id string, name string"))
    assert sorted(map(tuple, t.collect())) == [("1", 'say "hi",\nthere'), ("2", "")]
    files.write_csv(t, f"{tmp_path}/b.csv")
    assert files.read_any(spark, f"{tmp_path}/b.csv", t.schema).count() == 2
    (tmp_path / "ids.txt").write_text("c\na\nb\n")
    assert [x.value for x in files.read_lines(spark, f"{tmp_path}/ids.txt").orderBy("line_no").collect()] == ["c", "a", "b"]
    import hashlib

    assert files.digests(spark, f"{tmp_path}/ids.txt").first().sha256 == hashlib.sha256(b"c\na\nb\n").hexdigest()
    with pytest.raises(ValueError):
        files.read_any(spark, "x.docx", SCHEMA)


def test_documents_and_html(spark, tmp_path):
    (tmp_path / "a.md").write_text("word " * 40)
    (tmp_path / "b.txt").write_text("short")
    assert files.read_documents(spark, str(tmp_path)).count() == 1
    page = "<ul><li><div>1</div><div>A &amp; B</div><div>x</div><div><b>u</b></div></li><li><div>2</div></li></ul>"
    got = files.html_rows(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").collect()
    assert [x.cells for x in got] == [["1", "A & B", "x", "u"]]


def test_pruned_schema(spark, tmp_path):
    spark.createDataFrame([(1, ("a", [("x", 2)]))], "id int, s struct<n: string, l: array<struct<p: string, q: int>>>").write.parquet(f"{tmp_path}/t.parquet")
    t = pruned_table(spark, str(tmp_path), "t", ["id", "s.l.q"])
    assert t.schema.simpleString() == "struct<id:int,s:struct<l:array<struct<q:int>>>>"
    assert t.select(F.expr("transform(s.l, x -> x.q)").alias("q")).first().q == [2]
    with pytest.raises(ValueError):
        pruned_table(spark, str(tmp_path), "t", ["s.none"])


def test_resume_and_latest(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(1, "ok"), (2, "error"), (1, "ok")], "id int, status string")
    assert sorted(x.id for x in incremental.pending(items, done, "id", "status").collect()) == [2, 3]
    assert [x.id for x in incremental.pending(items, done, "id").collect()] == [3]
    t = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", None, 7), (None, 1, 9)], "k string, at int, v int")
    assert {x.k: x.v for x in incremental.last_wins(t, ["k"], ["at"]).collect()} == {"a": 5, "b": 7, None: 9}
    assert {x.k: x.v for x in incremental.first_wins(t, ["k"], ["at"]).collect()} == {"a": 1, "b": 7, None: 9}
    b = incremental.in_batches(spark.range(10).withColumn("g", F.lit(1)), "g", ["id"], 4).collect()
    assert [(x.batch_no, x.place) for x in sorted(b, key=lambda x: x.id)][3:5] == [(0, 3), (1, 0)]


def test_stream_appends_each_key_once_over_restarts(spark, tmp_path):
    schema = "id int, ts timestamp, kind string"
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    source.mkdir()

    def arrive(name, rows):
        (source / name).write_text("\n".join(json.dumps({"id": i, "ts": f"2024-01-01T00:0{m}:00Z", "kind": k}) for i, m, k in rows))

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        q = incremental.append_stream(stream, lambda b: b.withColumn("n", F.lit(1)), "id", "ts", "1 hour", out, checkpoint)
        q.awaitTermination(120)

    arrive("a.json", [(1, 0, "x"), (2, 1, "y"), (1, 0, "x")])
    run()
    arrive("b.json", [(2, 1, "y"), (3, 2, "x")])
    run()
    run()
    assert sorted(x.id for x in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windowed_counts_on_a_table(spark):
    t = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:04:00", "x"), ("2024-01-01 00:06:00", "y")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    got = sorted((x.k, x.n) for x in incremental.windowed_counts(t, "ts", "k", "5 minutes", "1 hour").collect())
    assert got == [("x", 2), ("y", 1)]


def test_paged_scan(spark):
    rows = [{"id": i, "title": f"t{i}"} for i in range(25)]
    want = [r["id"] for r in rows]
    for fetch in (lambda a, n: (rows[a : a + n], len(rows)), lambda a, n: (rows[a : a + n], None)):
        for limit in (0, 7, 25, 100):
            got = sorted(json.loads(x.value)["id"] for x in paged.paged(spark, fetch, 4, limit, 10).collect())
            assert got == want[: limit or None]
    assert paged.paged(spark, lambda a, n: ([], 0)).count() == 0


def test_calls_with_retries(spark):
    waits = []

    def flaky(row):
        row["tries"] = row.get("tries", 0) + 1
        if row["tries"] < 3:
            raise paged.Refused
        return row["tries"]

    assert paged.with_retries(flaky, wait=waits.append)({}) == 3 and waits == [0.5, 1.0]
    with pytest.raises(paged.Refused):
        paged.with_retries(flaky, attempts=1, wait=waits.append)({})
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, s string")
    for ordered in (True, False):
        got = {x.id: x for x in paged.called(df, lambda r: r["s"].upper(), 2, ordered).collect()}
        assert got[1].answer == '"A"' and got[1].error is None and got[2].answer is None and "AttributeError" in got[2].error


def test_json_documents_and_exact_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, "x"), (2, None, None)], "id int, v double, s string")
    files.write_json(df, f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_json(spark, f"{tmp_path}/d", df.schema).collect())) == [(1, 0.1 + 0.2, "x"), (2, None, None)]
    with pytest.raises(ValueError):
        files.write_json(df, f"{tmp_path}/e", most=1)
    files.write_csv(df, f"{tmp_path}/c", exact=True)
    assert {x.id: x.v for x in files.read_csv(spark, f"{tmp_path}/c").collect()}[1] == 0.1 + 0.2
    (tmp_path / "blank.csv").write_text("id,name\n1,a\n , \n,\n2,b\n")
    assert files.read_csv(spark, f"{tmp_path}/blank.csv", T.StructType.fromDDL("id string, name string")).count() == 2
    files.audit_sample(spark.range(100).withColumn("x", F.lit(1)), ["id"], f"{tmp_path}/s", 5)
    assert spark.read.json(f"{tmp_path}/s").columns == ["id"] and spark.read.json(f"{tmp_path}/s").count() == 5


def test_html_section(spark):
    page = "<h2>A</h2><p>x</p><h3>sub</h3>y<h2 class='k'>B</h2>z"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [x.s for x in df.select(files.html_section(F.col("h"), "A").alias("s")).collect()] == ["<p>x</p><h3>sub</h3>y", None]
    assert df.select(files.html_section(F.col("h"), "B").alias("s")).first().s == "z"


def test_upsert(spark):
    store = spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], "id string, name string, updated_at int")
    changes = spark.createDataFrame([("a", None, 2), ("a", "uno", 1), ("c", "three", 5), (None, "x", 9)], "id string, name string, updated_at int")
    assert sorted(map(tuple, incremental.upsert(store, changes, "id").collect())) == [("a", "one", 2), ("b", "two", 1), ("c", "three", 5)]
