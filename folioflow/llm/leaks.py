"""Problem 8: evaluation texts leaking into training text.

The test items are an inverted index with BM25 weights; every training passage is a
query. Terms are three words or Chinese characters, in the items one behind the other,
so that a changed word spoils one of them; what is listed are overlapping parts of the
items, each twice as long as a leak must be. Block-max WAND over sparse postings: a part is listed under its rare terms
only, as many as a run of it can't lose all (those beyond that pivot add to the full
score alone). Each term knows its largest weight, and its largest in each block of
items. Passages whose terms together can't reach the least bound are skipped; of the
others a block is opened only if the terms reach the least bound in it; only there
postings are added up. Of every pair that reaches the part's bound, with no limit on
their number, enough terms must stand in one place and enough of what the words tell
be there; then the words of document and item are aligned.

The thresholds are what the weakest run of an item keeps after the changes that the
alignment allows, so that retrieval loses nothing the alignment would accept. Blocks
of passages go through these steps at once as arrays. Indexes are built in tasks, of
about TOKENS_AT_ONCE tokens each, and broadcast one by one; the corpus is read once
per index and never shuffled but for the pairs found.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut
from folioflow.plans.sizes import bounded_rows
from folioflow.sources.tables import table

#: Words, or Chinese characters, of an item in a row that make a leak.
LEAST_WORDS, LEAST_CHARACTERS = 30, 50
#: Length of a passage's half, in tokens: a passage is two halves, and passages overlap by one.
HALF_WORDS, HALF_CHARACTERS = 40, 64
#: BM25's parameters; items in a block.
K1, B, BLOCK = 1.2, 0.4, 8
#: Share of an item's threshold that the terms it is listed under must be able to reach.
LISTED = 0.8
#: What an alignment loses for a changed, added or dropped token, the most of them in one place, and tokens in an anchor.
LOSS, GAP, ANCHOR_WORDS, ANCHOR_CHARACTERS = 3.0, 4, 3, 5
#: The most that may be changed, added or dropped, as a share of the run, and the least share of the run's
#: information (the sum of its words' inverse document frequencies over the items) that must be kept: a sentence
#: after the same pattern keeps the pattern's words and changes just those that tell.
CHANGED, INFORMATION = 0.15, 0.9
#: What a passage's words must have of some run before an alignment is tried: a run within a longer one may have a little less of it.
COVERED = 0.87
#: Documents that go through the arrays together.
DOCUMENTS_AT_ONCE = 384
#: Tokens in a term.
TERM = 3
#: Tokens of the items in one index; about 50 bytes each in every worker, 300 while it is built.
TOKENS_AT_ONCE = 2_000_000
_TAG = re.compile(r"<[^<>\n]{1,60}>")
_TOKEN = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+(?:[-.'’‐‑·][^\\W_㐀-鿿]+)*")
_JOINERS = str.maketrans("", "", "-.'’‐‑·")
_HAN = re.compile("[㐀-鿿]")
#: More than the tokens of a part; keys up to which sums lie in one array.
_PLACES, _DENSE = 128, 8_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def tokens(text: str) -> list[str]:
    """Words and single Chinese characters, without case, markup and layout.

    A word keeps its inner hyphens, points and apostrophes out, so that a hyphen at a
    line's end changes nothing.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    text = _TAG.sub(" ", text).lower().replace("-\r\n", "-").replace("-\n", "-").replace("*", "").replace("`", "").replace("\\_", "_")
    return [t if t.isalpha() else t.translate(_JOINERS) for t in _TOKEN.findall(text)]


def _chinese(t: str) -> bool:
    return "㐀" <= t <= "鿿"


def _spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (many[0] numbers), then those of the next."""
    return np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _totals(keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Each row's sum of the weights of its key; keys are below ``size``."""
    if size <= _DENSE:
        return np.bincount(keys, weights, size)[keys]
    _, where = np.unique(keys, return_inverse=True)
    return np.bincount(where, weights)[where]


class Index:
    """BM25 over items, for passages in bulk. ``seen`` and ``total``: in how many items a word stands, of how many, if there are further indexes."""

    def __init__(self, items: list[tuple[int, list[str]]], seen: dict[str, int] | None = None, total: int | None = None):
        if seen is None:
            seen = {}
            for _, x in items:
                for t in set(x):
                    seen[t] = seen.get(t, 0) + 1
        n, total = len(items), total or len(items)
        # Number 0 is any token that no item has.
        self.number: dict[str, int] = {}
        for _, x in items:
            for t in x:
                self.number.setdefault(t, len(self.number) + 1)
        self.is_chinese = np.array([False, *map(_chinese, self.number)], bool)
        seen_of = np.array([0, *(seen[t] for t in self.number)], float)
        information = np.log(1 + (total - seen_of + 0.5) / (seen_of + 0.5))
        # Items with the same smallest term lie together, so that the blocks are alike inside.
        parts = [self._numbers([x])[:-3] for _, x in items]
        order = sorted(range(n), key=lambda j: (self._smallest(parts[j]), j))
        self.ids = np.array([items[j][0] for j in order], dtype=np.int64)
        parts = [parts[j] for j in order]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)
        self.upto = np.concatenate([[0.0], np.cumsum(information[self.flat])])
        han = np.concatenate([[0], np.cumsum(self.is_chinese[self.flat])])
        self.chinese = 2 * (han[self.start[1:]] - han[self.start[:-1]]) > sizes
        # The term at each token; those that would reach into the next item are none.
        keys, ok = self._keys(np.concatenate([np.zeros(0, np.int64), *(x for p in parts for x in (p, np.zeros(3, np.int64)))]))
        real = np.ones(len(keys), bool)
        for z in range(3):
            real[np.cumsum(sizes + 3) - 1 - z] = False
        self.key_at, self.has_key = keys[real], ok[real]
        # One behind the other.
        item_of = np.repeat(np.arange(n), sizes)
        ok = self.has_key & ((np.arange(len(self.flat)) - self.start[item_of]) % TERM == 0)
        every, term_at = np.unique(self.key_at[ok], return_inverse=True)
        pair, inverse, tf = np.unique(term_at * max(1, n) + item_of[ok], return_inverse=True, return_counts=True)
        term, item = pair // max(1, n), pair % max(1, n)
        df = np.bincount(term, minlength=len(every))
        length = np.bincount(item_of[ok], minlength=n) / max(1.0, float(ok.sum()) / max(1, n))
        weight = (np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item]))).astype(np.float32)
        self.weight_at, rarity = np.zeros(len(ok), np.float32), np.zeros(len(ok), np.int64)
        self.weight_at[ok], rarity[ok] = weight[inverse], df[term_at]
        # Where the same term stood before in the item: within a run it counts once.
        before, by_pair = np.full(len(ok), -1), np.argsort(inverse, kind="stable")
        again = inverse[by_pair[1:]] == inverse[by_pair[:-1]]
        where = np.flatnonzero(ok)[by_pair]
        before[where[1:][again]] = where[:-1][again]
        # Parts: every run of an item that is just long enough lies in one.
        size = np.where(self.chinese, LEAST_CHARACTERS, LEAST_WORDS)
        many = np.maximum(0, sizes // size)
        self.part_item = np.repeat(np.arange(n), many)
        self.part_start = self.start[self.part_item] + (_spread(np.zeros(n, np.int64), many)) * size[self.part_item]
        self.part_end = np.minimum(self.part_start + 2 * size[self.part_item] - 1, self.start[self.part_item + 1])
        self.threshold = self._least(self.weight_at, before)
        # The terms a part is listed under: the rarest, up to the first power of two of items that will do.
        parts_n = len(self.part_item)
        self.bound, upto, most = np.full(parts_n, np.inf), np.zeros(parts_n), 1
        left = np.ones(parts_n, bool)
        while left.any():
            bound = self._least(np.where(rarity <= most, self.weight_at, 0), before, left)
            will = left & ((bound >= np.maximum(LISTED * self.threshold, 1e-3)) | (most >= n))
            self.bound[will], upto[will] = bound[will], most
            left, most = left & ~will, 2 * most
        number_at = np.zeros(len(ok), np.int64)
        number_at[ok] = term_at
        places, part = _spread(self.part_start, self.part_end - self.part_start), np.repeat(np.arange(parts_n), self.part_end - self.part_start)
        listed = ok[places] & (rarity[places] <= upto[part])
        places, part = places[listed], part[listed]
        # Each occurrence is a posting; those after the first weigh nothing.
        by_term = np.lexsort((places, part, number_at[places]))
        places, part = places[by_term], part[by_term]
        term = number_at[places]
        first = np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1]))
        in_list = np.zeros(len(ok), np.float32)
        self.need = np.full(parts_n, np.inf)
        for most in np.unique(upto):
            in_list[:] = ok & (rarity <= most)
            some = upto == most
            self.need[some] = np.maximum(1, self._least(in_list, before, some)[some])
        self.need = self.need.astype(np.int64)
        self.keys, term = np.unique(every[term], return_inverse=True)
        self.post_part, self.post_weight = part.astype(np.int32), np.where(first, self.weight_at[places], 0).astype(np.float32)
        self.post_place = (places - self.part_start[part]).astype(np.int32)
        v = len(self.keys)
        # Which last bits of a hash some listed term has.
        self.sieve = np.zeros(1 << max(10, (8 * v).bit_length()), bool)
        self.sieve[(self.keys & np.uint64(len(self.sieve) - 1)).astype(np.int64)] = True
        # Entries: a term in a block, with its largest weight there and where its postings begin.
        self.blocks = max(1, -(-parts_n // BLOCK))
        key, begin = np.unique(term * self.blocks + self.post_part // BLOCK, return_index=True)
        self.entry_block = (key % self.blocks).astype(np.int32)
        self.entry_at = np.append(begin, len(self.post_part))
        self.entry_max = np.maximum.reduceat(self.post_weight, begin) if len(key) else np.zeros(0, np.float32)
        self.at = np.searchsorted(key, np.arange(v + 1) * self.blocks)
        self.term_max = np.zeros(v, np.float32)
        np.maximum.at(self.term_max, key // self.blocks, self.entry_max)
        self.block_least = np.minimum.reduceat(self.bound, np.arange(0, parts_n, BLOCK)) if parts_n else np.zeros(0)
        self.least = float(self.bound.min()) if parts_n else np.inf
        self.anchors: dict[int, dict[tuple[int, ...], list[int]]] = {}

    def _numbers(self, docs: list[list[str]]) -> np.ndarray:
        """The tokens' numbers, with three zeros behind each document."""
        get, flat = self.number.get, []
        for d in docs:
            flat += [get(t, 0) for t in d]
            flat += (0, 0, 0)
        return np.array(flat, dtype=np.int64)

    def _keys(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of 64 bits of the term that begins at each token, and whether all its tokens are some item's.

        Single words say little where texts are written after the same patterns. Two
        terms of one hash, one pair in 10**19, could only bring up a pair that the
        alignment then refuses.
        """
        w = np.concatenate([numbers, np.zeros(2, np.int64)]).astype(np.uint64)
        a, b, c = w[:-2], w[1:-1], w[2:]
        h = a
        for x, m in ((b, _MIX[0]), (c, _MIX[1])):
            h = (h + np.uint64(1)) * m
            h ^= h >> np.uint64(31)
            h += x
        h *= _MIX[2]
        return h ^ (h >> np.uint64(29)), (a > 0) & (b > 0) & (c > 0)

    def _smallest(self, numbers: np.ndarray) -> int:
        keys, known = self._keys(numbers)
        return int(keys[known].min()) if known.any() else 0

    def _least(self, weight_at: np.ndarray, before: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Per part the least score that a run of it, as long as a leak must be, keeps after the changes allowed.

        A changed token takes away one term: of the run's terms as many, the heaviest, are taken off.
        """
        out = np.full(len(self.part_item), np.inf)
        for chinese, size in ((False, LEAST_WORDS), (True, LEAST_CHARACTERS)):
            taken, terms = int(CHANGED * size), size - TERM + 1
            wanted = self.chinese[self.part_item] == chinese
            of = np.flatnonzero(wanted if some is None else wanted & some)
            for j in range(0, len(of), 1000):
                part = of[j : j + 1000]
                many = self.part_end[part] - self.part_start[part] - size + 1
                at, owner = _spread(self.part_start[part], many), np.repeat(part, many)
                places = at[:, None] + np.arange(terms)
                w = np.where(before[places] < places[:, :1], weight_at[places], 0)
                np.minimum.at(out, owner, np.partition(w, terms - taken - 1, axis=1)[:, : terms - taken].sum(axis=1))
        return out

    def words_of(self, item: int) -> list[int]:
        return self.flat[self.start[item] : self.start[item + 1]].tolist()

    def anchors_of(self, item: int) -> dict[tuple[int, ...], list[int]]:
        """Where in an item each sequence of an anchor's length stands."""
        if item not in self.anchors:
            if len(self.anchors) > 5000:
                self.anchors.clear()
            x, k, where = self.words_of(item), ANCHOR_CHARACTERS if self.chinese[item] else ANCHOR_WORDS, {}
            for j in range(len(x) - k + 1):
                where.setdefault(tuple(x[j : j + k]), []).append(j)
            self.anchors[item] = where
        return self.anchors[item]

    def regions(self, docs: list[list[str]]) -> tuple[dict[tuple[int, int], tuple[int, int]], list[np.ndarray]]:
        """Of each pair (document, item) with passages above the item's threshold their first and last token; and the documents' token numbers."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        hits, numbers = self.passages(docs)
        for d, i, lo, hi in hits:
            a, b = found.get((d, i), (lo, hi))
            found[d, i] = min(a, lo), max(b, hi)
        return found, numbers

    def passages(self, docs: list[list[str]]) -> tuple[list[tuple[int, int, int, int]], list[np.ndarray]]:
        """(document, item, first token, last token) of every passage at or above the item's threshold, documents by position; and the documents' token numbers."""
        if not docs or self.least == np.inf:
            return [], []
        v, n, exact = len(self.keys), len(self.part_item), 1 - 1e-5
        half = [HALF_CHARACTERS if d and not (text := "".join(d)).isascii() and 3 * len(_HAN.findall(text)) > len(d) else HALF_WORDS for d in docs]
        sizes = np.array([len(d) + 3 for d in docs])
        numbers = self._numbers(docs)
        lists = np.split(numbers, np.cumsum(sizes)[:-1])
        halves = np.array(half)
        first_cell = np.concatenate([[0], np.cumsum(-(-sizes // halves) + 1)])  # an empty cell begins each document
        place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = np.repeat(first_cell[:-1] + 1, sizes) + place // np.repeat(halves, sizes)
        whole = cell
        keys, known = self._keys(numbers)
        keys, cell = keys[known], cell[known]
        maybe = np.flatnonzero(self.sieve[(keys & np.uint64(len(self.sieve) - 1)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.keys, keys[maybe]), v - 1)
        is_listed = self.keys[t] == keys[maybe]
        own = cell[maybe[is_listed]] * v + t[is_listed]
        # A passage is a cell and the one after it.
        own = _distinct(np.concatenate([own, own - v]))
        p, t = own // v, own % v
        reach = np.bincount(p, self.term_max[t], int(first_cell[-1]) + 1)
        some = reach[p] >= self.least * exact
        p, t = p[some], t[some]
        many = self.at[t + 1] - self.at[t]
        entry, at = _spread(self.at[t], many), np.repeat(p, many)
        block = self.entry_block[entry]
        some = _totals(at * self.blocks + block, self.entry_max[entry], (int(first_cell[-1]) + 1) * self.blocks) >= self.block_least[block] * exact
        entry, at = entry[some], at[some]
        many = self.entry_at[entry + 1] - self.entry_at[entry]
        post = _spread(self.entry_at[entry], many)
        pair = np.repeat(at, many) * n + self.post_part[post]
        some = _totals(pair, self.post_weight[post], (int(first_cell[-1]) + 1) * n) >= self.bound[self.post_part[post]] * exact
        # As many terms as must be left stand in one run.
        place = np.sort(pair[some] * _PLACES + self.post_place[post[some]])
        pair, place = place // _PLACES, place % _PLACES
        last = np.arange(len(pair)) + self.need[pair % n] - 1
        some = last < len(pair)
        last = np.minimum(last, len(pair) - 1)
        reach = np.where(self.chinese[self.part_item[pair % n]], LEAST_CHARACTERS, LEAST_WORDS) - TERM
        pair = _distinct(pair[some & (pair[last] == pair) & (place[last] - place <= reach)])
        if not len(pair):
            return [], lists
        words = self._words(pair // n, numbers, whole, int(first_cell[-1]) + 2)
        hits = []
        for a in range(0, len(pair), 20_000):
            c, i = pair[a : a + 20_000] // n, pair[a : a + 20_000] % n
            good = self._kept(words(c), i)
            c, i = c[good], self.part_item[i[good]]
            d = np.searchsorted(first_cell, c, side="right") - 1
            start = (c - first_cell[d] - 1) * halves[d]
            hits += zip(d.tolist(), i.tolist(), np.maximum(0, start).tolist(), (start + 2 * halves[d]).tolist(), strict=True)
        return sorted(hits), lists

    def _words(self, passages: np.ndarray, numbers: np.ndarray, cell: np.ndarray, cells: int):
        """Per passage, of those given, a function from numbers of words to whether they stand in it."""
        v, some = len(self.number) + 1, _distinct(passages)
        row = np.full(cells, -1)
        row[some] = np.arange(len(some))
        rows = np.concatenate([row[cell], row[cell - 1]])
        keys = (rows * v + np.concatenate([numbers, numbers]))[(rows >= 0) & (np.concatenate([numbers, numbers]) > 0)]
        if len(some) * v <= 4 * _DENSE:
            there = np.zeros(len(some) * v, bool)
            there[keys] = True
            return lambda c: lambda owner, word: there[row[c][owner] * v + word]
        keys = _distinct(keys)

        def search(c: np.ndarray):
            def inside(owner: np.ndarray, word: np.ndarray) -> np.ndarray:
                wanted = row[c][owner] * v + word
                return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

            return inside

        return search

    def _kept(self, inside, i: np.ndarray) -> np.ndarray:
        """Of which parts i some run that is long enough has COVERED of its information in words of the passage."""
        many = self.part_end[i] - self.part_start[i]
        at, owner = _spread(self.part_start[i], many), np.repeat(np.arange(len(i)), many)
        covered = inside(owner, self.flat[at])
        # The largest (covered - COVERED * whole) over all runs, by sums up to each place: those of one pair lie above all of the next.
        whole = self.upto[at + 1] - self.upto[at]
        over = np.concatenate([[0.0], np.cumsum(whole * (covered - COVERED))])
        step = 1 + float(over.max() - over.min())
        least = np.minimum.accumulate(over[:-1] - owner * step)
        size = np.where(self.chinese[self.part_item[i]], LEAST_CHARACTERS, LEAST_WORDS)[owner]
        ends = np.flatnonzero(_spread(np.zeros(len(i), np.int64), many) >= size - 1)
        holds = over[ends + 1] - (least[ends - size[ends] + 1] + owner[ends] * step) >= -1e-6
        out = np.zeros(len(i), bool)
        out[owner[ends[holds]]] = True
        return out


def _runs(doc: list[int], item: list[int], where: dict[tuple[int, ...], list[int]], k: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs (place in document, in item, length) of at least k tokens."""
    seen, runs = set(), []
    part = doc[max(0, lo) : hi]
    for i, key in enumerate(zip(*(part[x:] for x in range(k)), strict=False), max(0, lo)):
        for j in where.get(key, ()):
            if (i, j) in seen:
                continue
            z = 0
            while i + z < len(doc) and j + z < len(item) and doc[i + z] == item[j + z]:
                seen.add((i + z, j + z))
                z += 1
            runs.append((i, j, z))
    return runs


def longest_run(doc: list[int], index: Index, number: int, lo: int, hi: int) -> int:
    """The words (Chinese characters) of an item in its best alignment with the document, given as token numbers, between lo and hi.

    Equal runs are chained while no more than GAP tokens are changed, added or dropped
    between them; each such token costs LOSS, so that a chain of too many changes falls
    apart. Of all chains within CHANGED and INFORMATION the one that spans most of the
    item counts.
    """
    item, chinese = index.words_of(number), bool(index.chinese[number])
    k = ANCHOR_CHARACTERS if chinese else ANCHOR_WORDS
    runs = sorted(_runs(doc, item, index.anchors_of(number), k, lo, hi))
    upto = index.upto[index.start[number] : index.start[number + 1] + 1]
    reach = max((z for _, _, z in runs), default=0) + GAP + k
    best, most = [], 0
    for a, (i, j, z) in enumerate(runs):
        score, from_j, changed, kept = float(z), j, 0, upto[j + z] - upto[j]
        for b in range(a - 1, -1, -1):
            i2, j2, z2 = runs[b]
            if i - i2 > reach:
                break
            gi, gj = i - i2 - z2, j - j2 - z2
            if gi < -k or gj < -k or gi > GAP or gj > GAP or i2 >= i or j2 >= j:
                continue
            over = max(0, -gi, -gj)
            cost = max(gi + over, gj + over, 1)
            s = best[b][0] + z - over - LOSS * cost
            if s > score:
                score, from_j, changed, kept = s, best[b][1], best[b][2] + cost, best[b][3] + upto[j + z] - upto[j + over]
        best.append((score, from_j, changed, kept))
        span = j + z - from_j
        if changed <= CHANGED * span and kept >= INFORMATION * (upto[j + z] - upto[from_j]):
            most = max(most, int(index.is_chinese[item[from_j : j + z]].sum()) if chinese else span)
    return most


def _search(index_of):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = index_of()
        for b in batches:
            rows = []
            for a in range(0, len(b), DOCUMENTS_AT_ONCE):
                part = b.iloc[a : a + DOCUMENTS_AT_ONCE]
                keys = part["doc_id"].tolist()
                found, numbers = index.regions([tokens(t) if t else [] for t in part["text"]])
                lists: dict[int, list[int]] = {}
                for (d, i), (lo, hi) in found.items():
                    if d not in lists:
                        lists[d] = numbers[d].tolist()
                    n = longest_run(lists[d], index, i, lo - GAP, hi + GAP)
                    if n >= (LEAST_CHARACTERS if index.chinese[i] else LEAST_WORDS):
                        rows.append((keys[d], int(index.ids[i]), n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    return step


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "tokens": b["text"].map(tokens)})


def _build(total: int):
    def step(key: tuple, items: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        index = Index([(i, list(t)) for i, t in zip(items["item_id"], items["tokens"], strict=True)], dict(zip(words["word"], words["n"], strict=True)), total)
        return pd.DataFrame({"chunk": [key[0]], "index": [pickle.dumps(index, protocol=5)]})

    return step


def leaks(documents: DataFrame, items: DataFrame, tokens_at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """``(doc_id, item_id, words)``: documents that contain a long enough run of an item, and how many of its words; distinct.

    Null ids and null or empty texts give no rows, an item shorter than a run can't
    leak; repeated documents and items count once; without items there are no rows.
    How many items stand in one index changes no row: what a word tells is counted
    over all items.
    """
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    said = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    told = cut(said.mapInPandas(_told, "item_id bigint, tokens array<string>"))
    size = told.agg(F.sum(F.size("tokens")).alias("tokens"), F.count("*").alias("items")).first()
    if not size.tokens:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words int")
    chunks = -(-size.tokens // tokens_at_once)
    told = told.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int"))
    words = told.select(F.col("chunk").alias("of"), F.explode(F.array_distinct("tokens")).alias("word"))
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    of_chunk = words.distinct().join(seen, "word")
    built = cut(told.groupBy("chunk").cogroup(of_chunk.groupBy("of")).applyInPandas(_build(size["items"]), "chunk int, index binary"))
    out = None
    for c in range(chunks):
        for row in bounded_rows(built.filter(F.col("chunk") == c), 1, "indexes of a chunk"):
            shared = spark.sparkContext.broadcast(bytes(row["index"]))
            part = docs.mapInPandas(_search(_Once(shared)), "doc_id bigint, item_id bigint, words int")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


class _Once:
    """A broadcast index, unpacked at most once per Python worker."""

    _built: dict[int, Index] = {}

    def __init__(self, shared):
        self.shared = shared

    def __call__(self) -> Index:
        # Workers are reused: an index is known by all it holds.
        key = xxhash.xxh3_128_intdigest(self.shared.value)
        if key not in _Once._built:
            _Once._built.clear()
            _Once._built[key] = pickle.loads(self.shared.value)
        return _Once._built[key]


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the items they contain."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items")).select("doc_id", "item_id")


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item its split and section, the documents that contain it and the longest run."""
    rows = leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    items = table(spark, folder, "heldout_items").select("item_id", "split", "section").dropDuplicates(["item_id"])
    return rows.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest")).join(items, "item_id")


QUERIES = {"p8_found": found, "p8_leaked_items": leaked_items}
ORACLE: dict[str, str] = {}
