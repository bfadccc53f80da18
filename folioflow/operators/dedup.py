"""Exact and near duplicates, and splits that keep them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.hashing import stable_unit
from folioflow.operators.components import connected_components, star_edges
from folioflow.plans.lineage import cut


def exact_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, group, size)``: the rows of equal values, named by their smallest key; a null value makes no group with others."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v"))
    groups = rows.filter("v is not null").groupBy("v").agg(F.min("key").alias("group"), F.count("*").alias("size"))
    out = rows.join(groups, "v", "left")
    return out.select(F.col("key").alias(key), F.coalesce("group", "key").alias("group"), F.coalesce("size", F.lit(1)).alias("size"))


def jaccard_links(sets: DataFrame, threshold: float, head: int | None = None) -> DataFrame:
    """``(a, b, jaccard)`` of the distinct token sets that are at least ``threshold`` alike, a before b.

    sets: ``id`` and ``tokens`` (arrays without repetition). Equal sets must be one row
    beforehand: they are linked by membership, not by pairs. Prefix filtering: with the
    tokens in order of rising frequency, two sets that are alike share a token among
    the first size - ceil(threshold * size) + 1 of each, so that frequent tokens never
    make candidates. With ``head`` a pair must also share one of the first ``head``
    tokens in alphabetical order, as in blocking by sorted tokens. Empty sets are
    alike to nothing.
    """
    rows = sets.filter(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("tokens"))
    exploded = rows.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count("*").alias("f"))
    ordered = exploded.join(frequency, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("o"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    keys = cut(ordered.select("id", "n", F.explode(F.slice(F.transform("o", lambda x: x["token"]), F.lit(1), prefix.cast("int"))).alias("token")))
    a, b = keys.select("token", F.col("id").alias("a"), F.col("n").alias("na")), keys.select("token", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "token").filter((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)).select("a", "b").distinct()
    full = met.join(rows.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    alike = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    full = full.withColumn("jaccard", alike).filter(F.col("jaccard") >= threshold - 1e-12)
    if head:
        full = full.filter(F.arrays_overlap(F.slice("ta", 1, head), F.slice("tb", 1, head)))
    return full.select("a", "b", "jaccard")


def duplicate_groups(df: DataFrame, key: str, exact: list[str], tokens: str | None = None, threshold: float = 0.9, head: int | None = 8) -> DataFrame:
    """``(key, group)``: the transitive closure of equal values in any of the ``exact`` columns and of alike token sets.

    The group is its smallest key. Rows with a null key are left out; null and empty
    values link nothing; every other row is in exactly one group.
    """
    rows = df.filter(F.col(key).isNotNull())
    edges = [star_edges(rows.withColumn("_v", F.nullif(F.col(c), F.lit(""))), "_v", key) for c in exact]
    if tokens:
        named = rows.filter(F.size(tokens) > 0).select(F.col(key).alias("member"), F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("set"))
        classes = cut(named.groupBy("set").agg(F.min("member").alias("id")).select("id", "set", F.split("set", " ").alias("tokens")))
        edges.append(named.join(classes.select("set", "id"), "set").filter("member <> id").select(F.col("member").alias("u"), F.col("id").alias("v")))
        edges.append(jaccard_links(classes.select("id", "tokens"), threshold, head).select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = connected_components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias(key), F.col("component").alias("group"))
    return rows.select(key).distinct().join(linked, key, "left").withColumn("group", F.coalesce("group", key))


def split_groups(members: DataFrame, key: str, group: str, fixed: str | None, seed: str, shares: tuple[float, float] = (0.1, 0.1), parity: bool = False) -> DataFrame:
    """``(key, group, split)``: groups as a whole to train, validation or test.

    fixed: a column that names a split for some rows; one member in test makes the
    group test, else one in validation makes it validation. The others go by the hash
    of the group: below the first share test, below both validation.
    """
    rank = F.when(F.col(fixed) == "test", 2).when(F.col(fixed) == "validation", 1).otherwise(0) if fixed else F.lit(0)
    groups = members.groupBy(group).agg(F.max(rank).alias("_r"))
    u = stable_unit(F.col(group).cast("string"), seed, parity)
    by_hash = F.when(u < shares[0], "test").when(u < sum(shares), "validation").otherwise("train")
    return members.join(groups, group).select(key, group, F.when(F.col("_r") == 2, "test").when(F.col("_r") == 1, "validation").otherwise(by_hash).alias("split"))
