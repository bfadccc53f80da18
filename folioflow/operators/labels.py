"""Labels from review scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.numbers import noise_scale


def list_mean(values: Column) -> Column:
    """The mean of an array; null for null or empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def weighted_rating(ratings: Column, confidences: Column, stated: Column) -> Column:
    """The mean of the ratings weighted by confidence if both lists are equally long and weigh anything, else the plain mean, else the stated mean."""
    weight = F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(F.zip_with(ratings, confidences, lambda r, c: r * c), F.lit(0.0), lambda s, x: s + x)
    weighted = F.when((F.size(ratings) > 0) & (F.size(ratings) == F.size(confidences)) & (weight > 0), total / F.when(weight > 0, weight))
    return F.coalesce(weighted, list_mean(ratings), stated)


def precision_weighted(reviews: DataFrame, item: str, rating: str, confidence: str, alpha: float = 0.2) -> DataFrame:
    """``(item, label, n)``: the mean of globally scaled ratings, each weighted by the precision its confidence stands for.

    Ratings go to [0, 1] and confidences to [alpha, 1] by the least and largest of the
    whole table, which reach all rows as one row. Rows with a null are left out; a
    table of one value has spread 1.
    """
    rows = reviews.filter(F.col(item).isNotNull() & F.col(rating).isNotNull() & F.col(confidence).isNotNull())
    ends = rows.agg(F.min(rating).alias("r0"), F.max(rating).alias("r1"), F.min(confidence).alias("c0"), F.max(confidence).alias("c1"))
    spread = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(F.lit(1.0))
    scaled = rows.crossJoin(F.broadcast(ends)).select(item, ((F.col(rating) - F.col("r0")) / spread("r0", "r1")).alias("s"), (alpha + (1 - alpha) * (F.col(confidence) - F.col("c0")) / spread("c0", "c1")).alias("c"))
    weighted = scaled.withColumn("w", 1 / noise_scale(F.col("c")) ** 2)
    return weighted.groupBy(item).agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("label"), F.count("*").alias("n"))
