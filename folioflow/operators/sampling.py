"""Reproducible samples: by hash, quota and band, never by a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import hash_order


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given order.

    Spark keeps only the first k of a group per task before the shuffle (its
    window-group limit), so that a hot group is never gathered whole.
    """
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def stratified_quota(df: DataFrame, strata: list[str], key: str, quotas: dict[tuple, int], seed: str, first: Column | None = None) -> DataFrame:
    """Per stratum its quota of rows in hash order, those with ``first`` true before the others; a stratum without a quota gives none.

    A stratum with fewer rows gives all it has.
    """
    names = [F.col(s).cast("string") for s in strata]
    quota = None
    for values, n in quotas.items():
        hit = F.lit(True)
        for c, v in zip(names, values, strict=True):
            hit = hit & (c == F.lit(str(v)))
        quota = F.when(hit, n) if quota is None else quota.when(hit, n)
    ordered = [F.desc(F.coalesce(first, F.lit(False)))] if first is not None else []
    most = max(quotas.values(), default=0)
    ranked = df.withColumn("_q", quota).filter("_q is not null")
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*ordered, hash_order(F.lit(seed), *names, F.col(key)), F.col(key)))
    return ranked.withColumn("_rn", rn).filter((F.col("_rn") <= most)).filter(F.col("_rn") <= F.col("_q")).drop("_rn", "_q")


def band_diverse(df: DataFrame, band: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each band first, then the best of the rest, ``k`` in all."""
    best = F.row_number().over(Window.partitionBy(band).orderBy(*order))
    return df.withColumn("_b", best).filter(F.col("_b") <= k).orderBy(F.desc(F.col("_b") == 1), *order).limit(k).drop("_b")
