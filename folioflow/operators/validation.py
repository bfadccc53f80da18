"""Rules over rows and tables; what breaks them comes out as rows, not as an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, message)`` for each row and rule that isn't true; unknown counts as broken. One pass over the table."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("message"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, message)`` for each key that names several rows."""
    return df.groupBy(key).count().filter("count > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated key").alias("message"))


def missing_references(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """``(key, message)`` for each value of ``key`` that the target table doesn't have."""
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().join(target.select(F.col(target_key).alias("_k")).distinct(), "_k", "left_anti").select(F.col("_k").cast("string").alias("key"), F.lit("no such target").alias("message"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overlapping(train: DataFrame, test: DataFrame, keys: list[Column]) -> DataFrame:
    """The train rows that share any of the keys with a test row; null and empty keys are shared by none."""
    out = None
    for k in keys:
        t = test.select(k.alias("_k")).filter("_k is not null and _k <> ''").distinct()
        hit = train.withColumn("_k", k).join(t, "_k", "left_semi").drop("_k")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def without_overlap(train: DataFrame, test: DataFrame, keys: list[Column], empty_matches: bool = False) -> DataFrame:
    """The train rows that share none of the keys with a test row.

    empty_matches: let empty keys meet, as older preparations did by accident, which
    drops every row whose key came out empty once any test row's did.
    """
    for k in keys:
        t = test.select(k.alias("_k")).filter("_k is not null" if empty_matches else "_k is not null and _k <> ''").distinct()
        train = train.withColumn("_k", k).join(t, "_k", "left_anti").drop("_k")
    return train


def strict_lookup(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """``df`` with the catalogue's columns for its key; a key that the catalogue lacks, a null key, or one that it has twice is an error.

    Both are counted before anything is joined; an empty table needs no catalogue.
    """
    twice = catalogue.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").count()
    unknown = df.select(key).distinct().join(catalogue.select(key).filter(F.col(key).isNotNull()), key, "left_anti").count()
    if twice or unknown:
        raise ValueError(f"{key}: {unknown} unknown and {twice} repeated keys")
    return df.join(catalogue, key)
