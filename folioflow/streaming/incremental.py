"""Resumable processing: what is done is left out, what is new is appended.

The batch form is an anti-join on the keys done so far; the streaming form hands
every micro-batch to the same step and appends, with duplicates left out by a
watermarked state, so that a restart from the checkpoint repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.ranks import group_row_number


def pending(items: DataFrame, done: DataFrame, key: str, status: str | None = None, ok: str = "ok") -> DataFrame:
    """The items whose key isn't done yet; with ``status`` only rows that are ``ok`` count as done."""
    finished = done.filter(F.col(status) == ok) if status else done
    return items.join(finished.select(key).distinct(), key, "left_anti")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in the given order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*key, "_r.*").select(*df.columns)


def upsert(store: DataFrame, changes: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """The store with changed rows in place of those of their key and new rows added; of several changes of a key the latest by ``at``.

    A patch: null fields of a change leave what the store has. Changes without a key count for nothing.
    """
    latest = last_wins(changes.filter(F.col(key).isNotNull()), [key], [at]).select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    both = store.join(latest, key, "full_outer")
    return both.select(*[F.col(c) if c == key or f"_{c}" not in both.columns else F.coalesce(f"_{c}", c).alias(c) for c in store.columns])


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order."""
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*key, "_r.*").select(*df.columns)


def in_batches(df: DataFrame, partition: str, order: list[str], size: int) -> DataFrame:
    """``df`` with ``batch_no`` and ``place``: consecutive rows of each partition in batches of ``size``."""
    rows = group_row_number(df, [partition], [F.col(c) for c in order], "_rn")
    return rows.withColumn("batch_no", F.floor((F.col("_rn") - 1) / size)).withColumn("place", ((F.col("_rn") - 1) % size).cast("int")).drop("_rn")


def append_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, time: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``step`` on what arrives and appends its Parquet rows to ``out``, each key once within the ``late`` watermark.

    Each micro-batch writes to a folder of its own number, overwriting what an
    interrupted attempt left there: exactly once.
    """
    fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling window and group; works on tables and, with late rows dropped, on streams."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
