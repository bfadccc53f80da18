"""A global row number without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``df`` with a row number from 1 over the whole table in the given order.

    Range partitions are sorted one by one; each row's place in its partition plus the
    rows of the partitions before it is the number. Only one count per partition comes
    to the driver. Ties in ``order`` fall as the sort leaves them, so that the order
    should end in a key. The sorted rows are cut off their lineage first: the numbers
    must not depend on how a lost partition is computed anew.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    block, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    counts = sorted((r.b, r.n) for r in placed.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for b, n in counts:
        offsets.append((b, before))
        before += n
    starts = spark.createDataFrame(offsets, "_block bigint, _before bigint")
    return placed.withColumn("_block", block).join(F.broadcast(starts), "_block").withColumn(name, F.col("_before") + place + 1).select(*df.columns, name)


def running_totals(df: DataFrame, value: str, sums: list[str], descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Per distinct ``value`` the sums of some columns at it and before it: ``(value, <c>, <c>_before)``.

    Ties are one row, so that averages of ranks, cumulative counts and thresholds come
    out the same whatever the order within them. Rows with a null value are left out.
    Like :func:`global_row_number` it never sorts in one task: blocks in the order of
    the values are summed on their own and carried on by one total per block.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg(*[F.sum(c).alias(c) for c in sums])
    placed = cut(per.repartitionByRange(partitions, order).withColumn("_block", F.spark_partition_id()))
    blocks = sorted(placed.groupBy("_block").agg(*[F.sum(c).alias(c) for c in sums]).collect())
    carried, rows = [0] * len(sums), []
    for b in blocks:
        rows.append((b["_block"], *map(float, carried)))
        carried = [x + (b[c] or 0) for x, c in zip(carried, sums, strict=True)]
    starts = spark.createDataFrame(rows, "_block int, " + ", ".join(f"_s_{c} double" for c in sums)) if rows else spark.createDataFrame([], "_block int, " + ", ".join(f"_s_{c} double" for c in sums))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(starts), "_block")
    return out.select(value, *sums, *[(F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums])


def group_row_number(df: DataFrame, group: list[str], order: list[Column], name: str = "row_number", size: str | None = None) -> DataFrame:
    """``df`` with a row number from 1 within each group and, if asked for, the group's size.

    The rows of all groups are numbered in one order of group and ``order``; less the
    number at which the group begins, that is the number within it. A group of a third
    of all rows is spread over as many range partitions as any other third. Null
    groups are a group of their own.
    """
    numbered = global_row_number(df, [*[F.asc_nulls_first(g) for g in group], *order], "_all")
    key = F.struct(*[F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group])
    starts = numbered.groupBy(key.alias("_g")).agg(F.min("_all").alias("_start"), F.count("*").alias("_size"))
    out = numbered.withColumn("_g", key).join(starts, "_g").withColumn(name, F.col("_all") - F.col("_start") + 1)
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_g", "_all", "_start", "_size")


def tile(number: Column, size: Column, tiles: int) -> Column:
    """Which of ``tiles`` parts of a group a row number lies in, from 1; the first parts are the larger ones."""
    q, r = F.floor(size / tiles), size % tiles
    large = r * (q + 1)
    return F.when(number <= large, F.floor((number - 1) / (q + 1)) + 1).otherwise(r + F.floor((number - 1 - large) / F.greatest(q, F.lit(1))) + 1).cast("int")


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` with the rank of ``value`` from 0, ties at their mean position; null for a null value."""
    totals = running_totals(df.withColumn("_one", F.lit(1)), value, ["_one"])
    ranks = totals.select(value, (F.col("_one_before") + (F.col("_one") - 1) / 2).alias(name))
    return df.join(ranks, value, "left")


def evenly_spaced(df: DataFrame, order: list[Column], k: int, half_even: bool = False) -> DataFrame:
    """``k`` rows at even distances of the ordered table, with ``sample_no`` from 0.

    The places are i * (n - 1) / (k - 1), rounded half up or half to even; for k = 1
    the middle. Where k exceeds the rows, rows come out repeatedly.
    """
    n = df.count()
    if not n or k <= 0:
        return df.withColumn("sample_no", F.lit(0)).limit(0)
    if k == 1:
        places = [(0, n // 2)]
    else:
        places = [(i, round(i * (n - 1) / (k - 1)) if half_even else int(i * (n - 1) / (k - 1) + 0.5)) for i in range(k)]
    wanted = df.sparkSession.createDataFrame(places, "sample_no int, _place bigint")
    numbered = global_row_number(df, order, "_number")
    return numbered.join(F.broadcast(wanted), F.col("_number") - 1 == F.col("_place")).drop("_number", "_place")


#: Which place of n sorted values, from 0, a quantile q has, by rule; a place between two values is filled in linearly.
PLACES = {
    "linear": lambda n, q: (n - 1) * q,
    "nearest_rank": lambda n, q: F.greatest(F.ceil(n * q) - 1, F.lit(0)),
    "truncated": lambda n, q: F.least(F.floor(n * q), n - 1),
    "rounded": lambda n, q: F.floor((n - 1) * q + 0.5),
}


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """``(group, n, <names>)``: exact quantiles per group, each as ``(q, rule)`` with a rule of PLACES.

    The rows are numbered in range partitions and only those at the places asked for
    go on, so that no group is buffered in one task. Null values count for nothing,
    null groups are a group.
    """
    known = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    numbered = group_row_number(known, group, [F.col("_v")], "_rn", "_n")
    places = {k: PLACES[rule](F.col("_n"), F.lit(q)) for k, (q, rule) in wanted.items()}
    at = F.col("_rn") - 1
    here = [at.isin(0)] + [(at == F.floor(p)) | (at == F.ceil(p)) for p in places.values()]
    kept = numbered.filter(reduce(lambda a, b: a | b, here))
    pick = lambda p: F.max(F.when(at == p, F.col("_v")))
    low = kept.groupBy(*group).agg(F.max("_n").alias("n"), *[pick(F.floor(p)).alias(f"_l_{k}") for k, p in places.items()], *[pick(F.ceil(p)).alias(f"_h_{k}") for k, p in places.items()])
    share = lambda k: PLACES[wanted[k][1]](F.col("n"), F.lit(wanted[k][0])) - F.floor(PLACES[wanted[k][1]](F.col("n"), F.lit(wanted[k][0])))
    return low.select(*group, "n", *[(F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * share(k)).alias(k) for k in wanted])
