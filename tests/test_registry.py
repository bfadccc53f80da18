import datetime
import decimal
import importlib
import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioflow.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True).returncode == 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("folioflow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "folioflow.llm", None)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(registry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return f"{float(x):.5f}" if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else str(x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_core_query_equals_its_sql(spark, sql, name):
    df = registry.queries()[name](spark, FOLDER)
    assert len(df.columns) == len(set(df.columns))
    got = df.collect()
    if name in registry.oracle_sql():
        want = sql.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert _rows(got, df.columns) == _rows(want.fetchall(), columns)
    else:
        assert len(got) > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_documents_that_differ_late_are_no_duplicates(spark, tmp_path):
    start = "a long text " * 17_000
    rows = [(1, start + "one", "x"), (2, start + "two", "x"), (3, start + "one\n", "x"), (4, "short", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.group, r["size"]) for r in registry.queries()["d01_exact_groups"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
    assert sum(r.groups for r in registry.queries()["d06_leak_free_split"](spark, str(tmp_path)).collect()) == 3
