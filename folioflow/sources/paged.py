"""Paged scans as a data source, and row-wise calls to services, with retries and bounded concurrency.

A fetcher is a picklable function; without a network it reads a local fixture.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (offset, limit) to a page: its rows and, if known, how many there are in all.
Fetch = Callable[[int, int], tuple[list[dict], int | None]]


class Slice(InputPartition):
    """Rows from ``offset`` up to ``end``, which is open for None."""

    def __init__(self, offset: int, end: int | None):
        self.offset, self.end = offset, end


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, page: int, limit: int, per_task: int):
        self.fetch, self.page, self.limit, self.per_task = fetch, page, limit, per_task

    def partitions(self) -> list[Slice]:
        _, count = self.fetch(0, 1)
        end = min(x for x in (count, self.limit or None) if x is not None) if count is not None or self.limit else None
        if end is None or count is None:
            return [Slice(0, end)]
        return [Slice(a, min(end, a + self.per_task)) for a in range(0, end, self.per_task)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        at = partition.offset
        while partition.end is None or at < partition.end:
            want = self.page if partition.end is None else min(self.page, partition.end - at)
            rows, _ = self.fetch(at, want)
            for r in rows[:want]:
                yield (json.dumps(r, ensure_ascii=False),)
            if len(rows) < want or not rows:
                return
            at += len(rows)


def paged(spark: SparkSession, fetch: Fetch, page: int = 1000, limit: int = 0, per_task: int = 10_000) -> DataFrame:
    """``(value)``: the rows of a paged service as JSON texts, at most ``limit`` if given.

    Where the service tells how many rows there are, slices of ``per_task`` rows are
    read side by side; else one task goes on until a page is short or empty.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "folioflow_paged"

        def schema(self) -> str:
            return "value string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, page, limit, per_task)

    spark.dataSource.register(Paged)
    return spark.read.format("folioflow_paged").load()


class Refused(Exception):
    """A service's answer that it is worth asking again."""


def with_retries(call: Callable[[dict], object], attempts: int = 4, first: float = 0.5, most: float = 5.0, wait: Callable[[float], None] = time.sleep) -> Callable[[dict], object]:
    """``call`` asked again after :class:`Refused`, the pauses doubling from ``first`` up to ``most``; the last refusal is raised."""

    def step(row: dict) -> object:
        for k in range(attempts):
            try:
                return call(row)
            except Refused:
                if k == attempts - 1:
                    raise
                wait(min(most, first * 2**k))
        raise AssertionError("no attempts")

    return step


def called(df: DataFrame, call: Callable[[dict], object], at_once: int = 4, ordered: bool = True) -> DataFrame:
    """``df`` with ``answer`` and ``error`` (JSON text and message, one of them null) of a call per row.

    Each task keeps up to ``at_once`` calls open, in the order of the rows or as they
    finish; a call that fails is a row with its error. What is to survive a restart is
    written by batches of pending keys (``streaming.incremental``).
    """
    names = df.columns

    def one(row: dict) -> tuple:
        try:
            return (*row.values(), json.dumps(call(row), ensure_ascii=False), None)
        except Exception as e:  # noqa: BLE001
            return (*row.values(), None, f"{type(e).__name__}: {e}")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                rows = b.astype(object).where(b.notna(), None).to_dict("records")
                done = pool.map(one, rows) if ordered else (f.result() for f in as_completed([pool.submit(one, r) for r in rows]))
                yield pd.DataFrame(list(done), columns=[*names, "answer", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(step, f"{kinds}, answer string, error string")
