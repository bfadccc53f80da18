"""Columnar shredding of nested records and tables rebuilt from the level sequences.

A record is cut into its leaf paths. Each leaf gets, in document order, its values
with a repetition level (which repeated ancestor starts anew here; 0: the record)
and a definition level (how many of the optional and repeated steps of the path are
there), as in Melnik et al., "Dremel" (2010). A table per repeated ancestor is then
rebuilt from the level sequences alone: the ordinal of an ancestor at depth k is the
count of entries so far with a repetition level of at most k.

Levels: every struct, array and leaf on the path is optional and adds one to the
definition level where it isn't null; an array adds one more for an element that is
there, null or not. Records must have a key of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """A leaf path, the definition level at which its value is there, and of each repeated step the path and the definition level at which its element is there."""

    path: str
    kind: T.DataType
    full: int
    repeated: tuple[tuple[str, int], ...]


def leaves(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[Leaf]:
    """All leaf paths of a schema; ``skip`` names top-level columns to leave out."""
    found: list[Leaf] = []

    def walk(kind: T.DataType, path: str, level: int, repeated: tuple[tuple[str, int], ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, level + 1 if path else level, repeated)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path, level + 2, (*repeated, (path if not repeated or repeated[-1][0] != path else f"{path}[]", level + 2)))
        else:
            found.append(Leaf(path, kind, level + 1, repeated))

    for f in schema.fields:
        if f.name not in skip:
            walk(f.dataType, f.name, 0, ())
    return found


def levels(value: Column, kind: T.DataType, steps: list[str]) -> Column:
    """The level sequence of one leaf, as an array of (rep, def, value)."""

    def entry(rep: Column, level: int, x: Column | None, leaf: T.DataType) -> Column:
        return F.struct(rep.cast("int").alias("rep"), F.lit(level).alias("def"), (F.lit(None).cast(leaf) if x is None else x).alias("value"))

    def leaf_of(k: T.DataType, rest: list[str]) -> T.DataType:
        while isinstance(k, (T.ArrayType, T.StructType)):
            k, rest = (k.elementType, rest) if isinstance(k, T.ArrayType) else (k[rest[0]].dataType, rest[1:])
        return k

    def walk(x: Column, k: T.DataType, rest: list[str], level: int, rep: Column, depth: int) -> Column:
        end = leaf_of(k, rest)
        gone = F.array(entry(rep, level, None, end))
        if isinstance(k, T.StructType):
            return F.when(x.isNull(), gone).otherwise(walk(x[rest[0]], k[rest[0]].dataType, rest[1:], level + 1, rep, depth))
        if isinstance(k, T.ArrayType):
            inner = lambda y, i: walk(y, k.elementType, rest, level + 2, F.when(i == 0, rep).otherwise(F.lit(depth + 1)), depth + 1)
            return F.when(x.isNull(), gone).when(F.size(x) == 0, F.array(entry(rep, level + 1, None, end))).otherwise(F.flatten(F.transform(x, inner)))
        return F.array(F.when(x.isNull(), entry(rep, level, None, end)).otherwise(entry(rep, level + 1, x, end)))

    return walk(value, kind, steps, 0, F.lit(0), 0)


def shred(df: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, seq, rep, def, value)`` of one leaf path: its column of values with the level sequences.

    A record without the leaf keeps one entry whose definition level says how far
    the path goes. Order within a record is ``seq``. A null key makes a record that
    can't be told from others: such rows are left out.
    """
    head, *steps = path.split(".")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), levels(F.col(head), df.schema[head].dataType, steps).alias("entries"))
    return rows.select("key", F.posexplode("entries").alias("seq", "e")).select("key", "seq", "e.rep", "e.def", "e.value")


def with_ordinals(column: DataFrame, depth: int) -> DataFrame:
    """A shredded column with the ordinals ``i1`` to ``i<depth>`` (from 0) of its repeated ancestors, from the repetition levels."""
    order = Window.partitionBy("key").orderBy("seq")
    for k in range(1, depth + 1):
        column = column.withColumn(f"at{k}", F.sum(F.when(F.col("rep") <= k, 1).otherwise(0)).over(order))
    for k in range(1, depth + 1):
        # Within the parent: the count so far less the count at which the parent began.
        parent = Window.partitionBy("key", *(["at" + str(k - 1)] if k > 1 else []))
        column = column.withColumn(f"i{k}", (F.col(f"at{k}") - F.min(f"at{k}").over(parent)).cast("int"))
    return column.drop(*[f"at{k}" for k in range(1, depth + 1)])


def repeated_table(df: DataFrame, key: str, ancestor: str) -> DataFrame:
    """The table of a repeated ancestor: a row per element, with the key of the record and the ordinals that lead back to it.

    Columns: ``key``, ``i1`` .. ``id`` (the ordinals of the repeated steps down to
    the ancestor) and each leaf that has this ancestor as its innermost repeated
    step, named by its path below it (``value`` for an array of plain values). An
    element that is null has a row whose leaves are null; an array that is null or
    empty has none.
    """
    own = [x for x in leaves(df.schema, (key,)) if x.repeated and x.repeated[-1][0] == ancestor]
    if not own:
        raise ValueError(f"{ancestor} is the innermost repeated step of no leaf")
    depth = len(own[0].repeated)
    ordinals = [f"i{k}" for k in range(1, depth + 1)]
    parts = []
    for leaf in own:
        name = leaf.path[len(ancestor.replace("[]", "")) + 1 :].replace(".", "_") or "value"
        column = with_ordinals(shred(df, key, leaf.path), depth).filter(F.col("def") >= leaf.repeated[-1][1])
        parts.append(column.select("key", *ordinals, F.struct(F.lit(name).alias("name"), F.col("value").cast("string").alias("value")).alias("leaf")))
    if len(parts) == 1:
        only = parts[0]
        return only.select("key", *ordinals, F.col("leaf.value").cast(own[0].kind).alias(own[0].path[len(ancestor.replace("[]", "")) + 1 :].replace(".", "_") or "value"))
    # Leaves of one ancestor have equally many elements there: they meet on the ordinals.
    names = [x.path[len(ancestor.replace("[]", "")) + 1 :].replace(".", "_") or "value" for x in own]
    kinds = dict(zip(names, (x.kind for x in own), strict=True))
    rows = reduce(DataFrame.unionByName, parts).groupBy("key", *ordinals)
    return rows.agg(*[F.max(F.when(F.col("leaf.name") == n, F.col("leaf.value"))).cast(kinds[n]).alias(n) for n in names])


def record_table(df: DataFrame, key: str) -> DataFrame:
    """The table of the records themselves: the key and every leaf without a repeated step, named by its path."""
    flat = [x for x in leaves(df.schema, (key,)) if not x.repeated]
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(x.path).alias(x.path.replace(".", "_")) for x in flat])


def reassemble_lists(table: DataFrame, depth: int, value: str) -> DataFrame:
    """The inverse for one leaf: per key the values in order of the ordinals, nested once per level above the innermost."""
    inner = table.groupBy("key", *[f"i{k}" for k in range(1, depth)]).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"i{depth}", value))), lambda x: x[value]).alias(value))
    for k in range(depth - 1, 0, -1):
        inner = inner.groupBy("key", *[f"i{j}" for j in range(1, k)]).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"i{k}", value))), lambda x: x[value]).alias(value))
    return inner


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key, that of the latest ``by``; rows with a null key are kept as they are, exact ties are broken by the row's hash.

    The fields travel as one struct under ``max_by``, combined before the shuffle.
    """
    rank = F.struct(F.col(by), F.xxhash64(*df.columns))
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("row"))
    return kept.select("row.*").unionByName(df.filter(F.col(key).isNull()))
