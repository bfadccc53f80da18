"""Problem 1: splits that keep related records together.

Records that share any entity are linked by star edges (every member of an entity to
its smallest member); connected components by alternating large-star and small-star;
the hash of the component falls into ranges in proportion to the wanted shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.identity import FORUM_SQL, SPLIT_SQL, VENUE_SQL, forum_of, split_of, venue_of
from folioflow.operators.components import connected_components, star_edges
from folioflow.plans.lineage import cut
from folioflow.plans.sizes import bounded_rows
from folioflow.sources.tables import pruned_table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Letters and digits of a title that names one work.
LEAST_LETTERS = 20


def entity_components(records: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """``(key, component)`` for every record; the component is its smallest key.

    entities: columns of one value each; a null shares nothing. Rows with a null key
    are left out, repeated rows count once, and a record of no entity, or alone in
    its entities, is a component of its own. An empty table gives no rows.
    """
    rows = records.filter(F.col(key).isNotNull())
    edges = reduce(DataFrame.unionByName, [star_edges(rows, e, key) for e in entities])
    linked = connected_components(edges).select(F.col("node").alias(key), "component")
    return rows.select(key).distinct().join(linked, key, "left").withColumn("component", F.coalesce("component", key))


def unit(c: Column, seed: str = "") -> Column:
    """A number from [0, 1) out of the first 32 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def assign_splits(components: DataFrame, key: str, shares: dict[str, float] = SHARES, seed: str = "", dealt_share: float | None = None) -> DataFrame:
    """``(key, component, split)``: each component in one split, the splits in proportion by records.

    The hash of the component falls into the ranges of the shares; that alone decides,
    so that further records never move others. Where single components hold much of
    all records the proportions are as uneven as these. ``dealt_share`` evens them out: components
    of more than that share of all records (at most its inverse, a proven bound) are
    dealt out first, largest to the split with most room, and the hash ranges follow
    the room that is left; then all records' splits depend on those components.
    """
    if dealt_share is None:
        return _by_ranges(components, key, shares, {}, seed)
    components = cut(components)
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    total = components.count()
    giants = bounded_rows(sizes.filter(F.col("n") > F.lit(total * dealt_share)).orderBy(F.desc("n"), "component"), int(1 / dealt_share) + 1, "giant components")
    room = {s: share * total for s, share in shares.items()}
    dealt = {}
    for g in giants:
        dealt[g.component] = max(room, key=room.get)
        room[dealt[g.component]] -= g.n
    return _by_ranges(components, key, {s: max(0.0, r) for s, r in room.items()}, dealt, seed)


def _by_ranges(components: DataFrame, key: str, room: dict[str, float], dealt: dict[str, str], seed: str) -> DataFrame:
    left, upto, names = sum(room.values()) or 1.0, 0.0, list(room)
    by_hash: Column | None = None
    u = unit(F.col("component"), seed)
    for s in names[:-1]:
        upto += room[s] / left
        by_hash = F.when(u < upto, s) if by_hash is None else by_hash.when(u < upto, s)
    by_hash = F.lit(names[-1]) if by_hash is None else by_hash.otherwise(names[-1])
    for c, s in dealt.items():
        by_hash = F.when(F.col("component") == F.lit(c), s).otherwise(by_hash)
    return components.select(key, "component", by_hash.alias("split"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """``(case_id, submission, split)``: the forum within its venue, null without either; distinct rows."""
    t = pruned_table(spark, folder, "cases", ["case_id", "source.forum_id", "source.venue_id", "source.split"])
    forum, venue = forum_of(F.col("source.forum_id")), venue_of(F.col("source.venue_id"))
    return t.select("case_id", F.when(forum.isNotNull() & venue.isNotNull(), F.concat(venue, F.lit("\n"), forum)).alias("submission"), split_of(F.col("source.split")).alias("split")).distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the groups that name more than one split."""
    rows = submissions(spark, folder)
    groups = cut(entity_components(rows, "case_id", ["submission"]))
    named = groups.join(rows.select("case_id", "split"), "case_id").groupBy("component").agg(*[F.max(F.col("split") == s).cast("int").alias(s) for s in SHARES])
    torn = named.filter(sum(F.coalesce(F.col(s), F.lit(0)) for s in SHARES) > 1).select("component")
    return groups.join(torn, "component", "left_semi").select(F.col("component").alias("group_case_id"), "case_id").distinct()


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """One split per case, beside the given one."""
    rows = submissions(spark, folder)
    made = assign_splits(entity_components(rows, "case_id", ["submission"]), "case_id")
    given = rows.groupBy("case_id").agg(F.max("split").alias("given_split"))
    return made.join(given, "case_id").select("case_id", "component", "split", "given_split")


def compared(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by made and given split."""
    return splits(spark, folder).groupBy("split", "given_split").agg(F.count("*").alias("cases"))


def linked(spark: SparkSession, folder: str) -> DataFrame:
    """Splits of cases that share a submission or, by its letters and digits, a title of some length; chains of both stay together."""
    t = pruned_table(spark, folder, "cases", ["case_id", "manuscript.title"])
    letters = F.regexp_replace(F.lower("manuscript.title"), "[^a-z0-9]+", "")
    titles = t.select("case_id", F.when(F.length(letters) >= LEAST_LETTERS, letters).alias("title")).distinct()
    rows = cut(submissions(spark, folder).select("case_id", "submission").join(titles, "case_id"))
    return assign_splits(entity_components(rows, "case_id", ["submission", "title"]), "case_id")


QUERIES = {"p1_found": found, "p1_splits": splits, "p1_compared": compared, "p1_linked": linked}

_ROWS = f"""r AS (SELECT DISTINCT case_id, {FORUM_SQL.format("source.forum_id")} AS f, {VENUE_SQL.format("source.venue_id")} AS v, {SPLIT_SQL.format("source.split")} AS s FROM cases WHERE case_id IS NOT NULL),
    g AS (SELECT DISTINCT case_id, s, CASE WHEN f IS NULL OR v IS NULL THEN case_id ELSE min(case_id) OVER (PARTITION BY v, f) END AS component FROM r)"""
_SPLIT = "CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END"
_SPLITS = f"SELECT case_id, component, {_SPLIT} AS split, max(s) AS given_split FROM (SELECT *, ('0x' || substr(md5(component), 1, 8))::UBIGINT / 4294967296.0 AS u FROM g) GROUP BY ALL"

ORACLE = {
    "p1_found": f"WITH {_ROWS} SELECT DISTINCT component AS group_case_id, case_id FROM g WHERE component IN (SELECT component FROM g GROUP BY 1 HAVING count(DISTINCT s) > 1)",
    "p1_splits": f"WITH {_ROWS} {_SPLITS}",
    "p1_compared": f"WITH {_ROWS} SELECT split, given_split, count(*) AS cases FROM ({_SPLITS}) GROUP BY ALL",
    "p1_linked": f"""WITH RECURSIVE r AS (SELECT DISTINCT case_id, {FORUM_SQL.format("source.forum_id")} AS f, {VENUE_SQL.format("source.venue_id")} AS v, regexp_replace(lower(manuscript.title), '[^a-z0-9]+', '', 'g') AS t FROM cases WHERE case_id IS NOT NULL),
        m AS (SELECT DISTINCT case_id, 's' || v || chr(10) || f AS e FROM r WHERE v IS NOT NULL AND f IS NOT NULL UNION SELECT case_id, 't' || t FROM r WHERE length(t) >= {LEAST_LETTERS}),
        star AS (SELECT DISTINCT case_id AS a, min(case_id) OVER (PARTITION BY e) AS b FROM m),
        link AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
        reach AS (SELECT case_id AS a, case_id AS b FROM r UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        c AS (SELECT a AS case_id, min(b) AS component FROM reach GROUP BY a)
        SELECT case_id, component, {_SPLIT} AS split FROM (SELECT *, ('0x' || substr(md5(component), 1, 8))::UBIGINT / 4294967296.0 AS u FROM c)""",
}
