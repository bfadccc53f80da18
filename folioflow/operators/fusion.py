"""Fusing and aggregating rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_rank_fusion(hits: DataFrame, item: str, query: str, rank: str, relevance: str) -> DataFrame:
    """``(item, hits, queries, rrf, relevance)``: per item its hits, distinct queries, the sum of 1 / (rank + 1) with ranks from 0, and the best relevance.

    Sort by queries, rrf and relevance, all descending, then by item.
    """
    return hits.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("hits"), F.count_distinct(query).alias("queries"), F.sum(1 / (F.col(rank) + 1.0)).alias("rrf"), F.max(relevance).alias("relevance"))


def borda(first: DataFrame, second: DataFrame, batch: str, item: str, rank: str) -> DataFrame:
    """``(batch, item, rank_sum)`` of two rankings of the same items per batch; items of one ranking only are left out."""
    a, b = first.select(batch, item, F.col(rank).alias("_a")), second.select(batch, item, F.col(rank).alias("_b"))
    return a.join(b, [batch, item]).select(batch, item, (F.col("_a") + F.col("_b")).alias("rank_sum"))


def order_agreement(first: DataFrame, second: DataFrame, batch: str, item: str, rank: str) -> DataFrame:
    """``(pairs, same, share)``: over the pairs within each batch, how many both rankings order alike.

    Batches are of fixed size by construction (slices of a few rows for one request),
    so that pairs within them grow with the rows only.
    """
    both = first.select(batch, item, F.col(rank).alias("ra")).join(second.select(batch, item, F.col(rank).alias("rb")), [batch, item])
    x, y = both.alias("x"), both.alias("y")
    met = x.join(y, (F.col(f"x.{batch}") == F.col(f"y.{batch}")) & (F.col(f"x.{item}") < F.col(f"y.{item}")))
    same = F.signum(F.col("x.ra") - F.col("y.ra")) == F.signum(F.col("x.rb") - F.col("y.rb"))
    return met.agg(F.count("*").alias("pairs"), F.sum(same.cast("bigint")).alias("same"), F.avg(same.cast("double")).alias("share"))
