"""Problem 7: filling fixed-capacity containers with items.

Exact-complement hashing over the histogram of lengths: a container opens with the
longest item left; a gap that one, two or three available lengths fill exactly is
closed by them (sets of single, pair and triple sums as bit sets), else the longest
item that fits goes in and the rest is tried again: best fit for what no combination
fills. One combination is used as often as the counts of its lengths allow.

The plan depends on the histogram alone, which has at most as many entries as the
capacity, and every combination uses up some length: plan and histogram are bounded
by the capacity whatever the data. The items are numbered by length in range partitions,
which share out a hot length as any other rows, and find their places by a binary
search among the slots of their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.ranks import global_row_number
from folioflow.plans.lineage import cut
from folioflow.plans.sizes import bounded_rows
from folioflow.sources.tables import pruned_table

CAPACITY = 1600
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary splits a text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str, capacity: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                n = len(encode(t)) if t else 0
                rows += [(i, k, k * capacity, min(capacity, n - k * capacity)) for k in range(max(1, -(-n // capacity)))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "tokens"])

    return step


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, first_token, tokens)``: each text whole, or in pieces of the capacity if it is longer.

    An empty text is one piece of no tokens; a null text is none.
    """
    return documents.filter("text is not null").select("doc_id", "text").mapInPandas(_count_tokens(vocabulary, capacity), "doc_id bigint, piece int, first_token int, tokens int")


class Plan:
    """Combinations of lengths with how often each is used."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
        self.there = sum(1 << n for n in self.left)
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        while self.left:
            combination = self._fill()
            needs: dict[int, int] = {}
            for n in combination:
                needs[n] = needs.get(n, 0) + 1
            times = min(self.left[n] // k for n, k in needs.items())
            self.patterns.append((tuple(combination), times))
            for n, k in needs.items():
                self.left[n] -= k * times
                if not self.left[n]:
                    del self.left[n]
                    self.there &= ~(1 << n)

    def _has(self, used: dict[int, int], *lengths: int) -> bool:
        need = dict(used)
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        return all(need[n] <= self.left.get(n, 0) for n in set(lengths))

    def _longest(self, used: dict[int, int], most: int) -> int:
        """The longest length up to ``most`` of which an item is left; 0 if none."""
        bits = self.there & ((1 << (most + 1)) - 1)
        while bits:
            n = bits.bit_length() - 1
            if self._has(used, n):
                return n
            bits &= ~(1 << n)
        return 0

    def _pair(self, used: dict[int, int], gap: int, turned: int) -> tuple[int, int] | None:
        """Two lengths of the sum ``gap``, the longest first; ``turned`` has the bit of capacity - n for each length n."""
        back = turned >> (self.capacity - gap) if gap <= self.capacity else 0
        bits = self.there & back & ((1 << gap) - 1)
        while bits:
            a = bits.bit_length() - 1
            if 2 * a < gap:
                return None
            if self._has(used, a, gap - a):
                return a, gap - a
            bits &= ~(1 << a)
        return None

    def _exact(self, used: dict[int, int], gap: int) -> tuple[int, ...] | None:
        if self._has(used, gap):
            return (gap,)
        turned = sum(1 << (self.capacity - n) for n in self.left)
        if (two := self._pair(used, gap, turned)) is not None:
            return two
        bits = self.there & ((1 << gap) - 1)
        while bits:
            a = bits.bit_length() - 1
            if 3 * a < gap:
                return None
            bits &= ~(1 << a)
            if self._has(used, a):
                rest = dict(used)
                rest[a] = rest.get(a, 0) + 1
                if (two := self._pair(rest, gap - a, turned)) is not None:
                    return (a, *two)
        return None

    def _fill(self) -> list[int]:
        first = self.there.bit_length() - 1
        taken, used, gap = [first], {first: 1}, self.capacity - first
        while gap > 0:
            longest = self._longest(used, gap)
            if not longest:
                break
            if gap <= 3 * longest and (rest := self._exact(used, gap)) is not None:
                return taken + list(rest)
            taken.append(longest)
            used[longest] = used.get(longest, 0) + 1
            gap -= longest
        return taken

    def ranges(self) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """(length, from rank, to rank, first container, position) of every slot, and the number of containers."""
        rows, rank, container = [], {}, 0
        for combination, times in self.patterns:
            for position, n in enumerate(combination):
                at = rank.get(n, 0)
                rows.append((n, at, at + times, container, position))
                rank[n] = at + times
            container += times
        return rows, container


def _placed(histogram: dict[int, int], capacity: int):
    """A function from numbers (from 1, by length) and lengths to container and position."""
    ranges, containers = Plan(histogram, capacity).ranges()
    starts, before = {}, 0
    for n in sorted(histogram):
        starts[n] = before
        before += histogram[n]
    slots = {n: tuple(np.array(x) for x in zip(*((lo, first, place) for m, lo, _, first, place in ranges if m == n), strict=True)) for n in {r[0] for r in ranges}}
    most = max((p for *_, p in ranges), default=-1) + 1

    def place(numbers: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(sizes), 2), np.int64)
        lengths, given = sizes.to_numpy(), numbers.to_numpy()
        for n in np.unique(lengths):
            here = lengths == n
            rank = given[here] - 1 - starts[int(n)]
            if n == 0:
                # Items without size are spread over the containers behind the others.
                out[here] = np.stack([rank % max(1, containers), most + rank // max(1, containers)], axis=1)
            else:
                lo, first, position = slots[int(n)]
                slot = np.searchsorted(lo, rank, side="right") - 1
                out[here] = np.stack([first[slot] + rank - lo[slot], position[slot]], axis=1)
        return pd.DataFrame(out, columns=["sequence", "position"])

    return place


def packed(pieces: DataFrame, capacity: int = CAPACITY, size: str = "tokens", key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The items with ``sequence`` and ``position`` (both from 0).

    pieces: items of ``size`` 0 to ``capacity``; larger ones are an error, a null size
    leaves the item out. Items without size are spread over the containers behind the
    others, in one container if there is no other. Repeated rows are items of their
    own. No items give no rows.
    """
    # Range partitions read their input twice, once for its quantiles: counting tokens is done by then.
    counted = cut(pieces.filter(F.col(size).isNotNull()))
    numbered = global_row_number(counted, [F.col(size), *map(F.col, key)], "_number")
    histogram = {r[size]: r["count"] for r in bounded_rows(numbered.groupBy(size).count(), capacity + 1, "lengths")}
    if histogram and (min(histogram) < 0 or max(histogram) > capacity):
        raise ValueError(f"an item of {max(histogram)} in containers of {capacity}")
    place = F.pandas_udf(_placed(histogram, capacity), "sequence bigint, position bigint")
    return numbered.withColumn("_slot", place("_number", size)).select(*pieces.columns, "_slot.sequence", "_slot.position")


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence and position of every text or piece."""
    return packed(token_pieces(pruned_table(spark, folder, "documents", ["doc_id", "text"])))


def fill(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences by how many of their tokens stay empty."""
    used = sequences(spark, folder).groupBy("sequence").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return used.groupBy((CAPACITY - F.col("tokens")).alias("empty_tokens")).agg(F.count("*").alias("sequences"), F.sum("pieces").alias("pieces"))


QUERIES = {"p7_sequences": sequences, "p7_fill": fill}
ORACLE: dict[str, str] = {}
