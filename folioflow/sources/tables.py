"""Reading the tables of a data folder, with pruned nested schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prune(kind: T.DataType, paths: list[tuple[str, ...]]) -> T.DataType:
    """``kind`` reduced to the leaf ``paths``; arrays are passed through without a step of their own."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(prune(kind.elementType, paths), True)
    if not isinstance(kind, T.StructType) or () in paths:
        return kind
    heads = dict.fromkeys(p[0] for p in paths)
    missing = [h for h in heads if h not in kind.fieldNames()]
    if missing:
        raise ValueError(f"no such field: {', '.join(missing)}")
    return T.StructType([T.StructField(f.name, prune(f.dataType, [p[1:] for p in paths if p[0] == f.name]), True) for f in kind.fields if f.name in heads])


def pruned_table(spark: SparkSession, folder: str, name: str, paths: list[str]) -> DataFrame:
    """The table with nothing but the dotted leaf ``paths``, so that the scan reads no other column.

    Catalyst prunes nested fields of plain projections, not those used inside a
    lambda; reading with a reduced schema works for both.
    """
    full = table(spark, folder, name).schema
    return spark.read.schema(prune(full, [tuple(p.split(".")) for p in paths])).parquet(f"{folder}/{name}.parquet")
