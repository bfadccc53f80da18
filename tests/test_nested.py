import random

from folioflow.operators.shred import latest, leaves, reassemble_lists, record_table, repeated_table, shred

SCHEMA = "id string, name string, a struct<b: array<struct<c: string, d: array<int>>>, e: double>, tags array<string>, deep array<array<int>>"
ROWS = [
    ("r1", "x", ([("c1", [1, 2]), ("c2", []), ("c3", None), None, (None, [None, 3])], 1.5), ["t", None, "t"], [[1, 2], [], None, [3]]),
    ("r2", None, ([], None), [], []),
    ("r3", "y", (None, 2.0), None, None),
    ("r4", "z", None, ["u"], [[None]]),
    (None, "lost", ([("c", [9])], 0.0), ["v"], [[9]]),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_levels_of_a_leaf(spark):
    got = [(r.seq, r.rep, r["def"], r.value) for r in shred(frame(spark), "id", "a.b.d").filter("key = 'r1'").orderBy("seq").collect()]
    assert [x[1] for x in got] == [0, 2, 1, 1, 1, 1, 2]
    assert [x[3] for x in got] == [1, 2, None, None, None, None, 3]
    full = next(x.full for x in leaves(frame(spark).schema, ("id",)) if x.path == "a.b.d")
    assert [x[2] == full for x in got] == [True, True, False, False, False, False, True]
    one = {r.key: r["def"] for r in shred(frame(spark), "id", "a.b.d").filter("key <> 'r1'").collect()}
    assert one["r2"] > one["r3"] > one["r4"]


def test_tables_per_ancestor(spark):
    df = frame(spark)
    b = {(r.key, r.i1): r.c for r in repeated_table(df, "id", "a.b").collect()}
    assert b == {("r1", 0): "c1", ("r1", 1): "c2", ("r1", 2): "c3", ("r1", 3): None, ("r1", 4): None}
    d = {(r.key, r.i1, r.i2): r.value for r in repeated_table(df, "id", "a.b.d").collect()}
    assert d == {("r1", 0, 0): 1, ("r1", 0, 1): 2, ("r1", 4, 0): None, ("r1", 4, 1): 3}
    tags = {(r.key, r.i1): r.value for r in repeated_table(df, "id", "tags").collect()}
    assert tags == {("r1", 0): "t", ("r1", 1): None, ("r1", 2): "t", ("r4", 0): "u"}
    assert {r.key: (r.name, r.a_e) for r in record_table(df, "id").collect()} == {"r1": ("x", 1.5), "r2": (None, None), "r3": ("y", 2.0), "r4": ("z", None)}


def test_round_trip_of_random_lists(spark):
    r = random.Random(3)
    rows = [(f"k{i}", [[r.randrange(9) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 5))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, deep array<array<int>>")
    t = repeated_table(df, "id", "deep[]")
    assert {x.key: x.value for x in reassemble_lists(t, 2, "value").collect()} == dict(rows)


def test_one_record_with_most_elements(spark):
    rows = [("big", None, ([(f"c{i}", [i]) for i in range(5000)], None), None, None)]
    t = repeated_table(frame(spark, rows), "id", "a.b.d")
    assert t.count() == 5000 and t.filter("value <> i1 or i2 <> 0").count() == 0


def test_empty_table_and_latest(spark):
    assert repeated_table(frame(spark, []), "id", "a.b").count() == 0
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "z"), (None, 5, "z"), ("a", 2, "y")], "id string, at int, v string")
    got = sorted((r.id or "", r.v or "") for r in latest(df, "id", "at").collect())
    assert got == [("", "z"), ("", "z"), ("a", "y"), ("b", "")]
    assert latest(df.limit(0), "id", "at").count() == 0
