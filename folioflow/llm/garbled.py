"""Problem 9: garbled text from wrong character encoding.

A noisy channel: the original text, in encoding S, was decoded as W. A suspicious
piece of text is turned back into the bytes that W had read, with a wildcard for each
byte that was lost; the lattice of these bytes, in which a sound character may also
stand for itself, is decoded under each S by a Viterbi search. Its scores come from the corpus:
the frequencies of its words beyond ASCII and of its pairs of characters, counted over
all documents. A piece is garbled where the best original is far more probable than
what stands there. (Bytes without a gap that are sound throughout have a single path
through the lattice, which is taken without a search.) A replacement character is
evidence by itself: no text had it before it was decoded.

The counts are made by one pass (summed per batch, then in Spark). The most frequent
MOST_WORDS words and MOST_PAIRS pairs make the model, however large the corpus, and are
broadcast; every document is judged.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut
from folioflow.plans.sizes import bounded_rows
from folioflow.sources.tables import pruned_table

#: Words and pairs in the model at most, and the least count.
MOST_WORDS, MOST_PAIRS, LEAST = 150_000, 100_000, 2
#: Longest piece that counts as a word.
WORD_LENGTH = 40
#: How much more probable (in nats) an original must be, for a piece alone and for a document's pieces together.
PIECE_GAIN, DOCUMENT_GAIN = 5.0, 5.0
#: How much more frequent than what stands there the word must be that a single changed byte points to, and its least count.
WORD_RATIO, WORD_COUNT = 20.0, 4
#: States kept at each byte of the lattice, readings of a gap, rounds for text garbled more than once.
BEAM, READINGS, ROUNDS = 12, 256, 3
#: What a lost byte, and a sound character among garbled ones, cost in nats.
LOSS, SOUND = 6.0, 2.0

# Encodings of one byte a character that text is written in or taken for.
SINGLE = ("cp1252", "iso8859-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp1254")
LOST = "�"
MARK = "\ufeff"
_WORD_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; a byte that the encoding leaves open is the control character of its number."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


TO_BYTE = {e: _bytes_of(e) for e in SINGLE}
FROM_BYTE = {e: {b: c for c, b in reversed(t.items())} for e, t in TO_BYTE.items()}
#: How the UTF-8 byte order mark reads in each.
MARKS = tuple(dict.fromkeys("".join(FROM_BYTE[e][b] for b in MARK.encode()) for e in SINGLE))


def pieces(text: str) -> list[str]:
    """The parts of a text between ASCII blanks that are not all ASCII; other blanks may be parts of garbled characters."""
    return [p.decode("utf-8", "surrogatepass") for p in text.encode("utf-8", "surrogatepass").split() if not p.isascii()]


#: ASCII stands for its class: letter, digit or the sign itself.
_CLASSES = {ord(c): "a" if c.isalpha() else "0" for c in map(chr, range(128)) if c.isalnum()}


def pairs(piece: str) -> list[str]:
    """The pairs of neighbouring characters of which at least one is beyond ASCII, with blanks at the ends."""
    s = f" {piece} ".translate(_CLASSES)
    return [x + y for x, y in zip(s, s[1:], strict=False) if x > "\x7f" or y > "\x7f"]


def word(piece: str) -> str:
    return piece.strip(_WORD_EDGE).lower()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words, two = Counter(), Counter()
        for t in b["text"]:
            if t and not t.isascii():
                for p in pieces(t):
                    two.update(pairs(p))
                    if len(p) <= WORD_LENGTH and (w := word(p)):
                        words[w] += 1
        rows = [("w", k, n) for k, n in words.items()] + [("p", k, n) for k, n in two.items()]
        yield pd.DataFrame(rows, columns=["kind", "key", "n"])


def counts(documents: DataFrame) -> DataFrame:
    """``(kind, key, n)``: how often each word beyond ASCII (w) and each pair of characters (p) occurs in the whole table."""
    return documents.select("text").mapInPandas(_count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """Scores of words and pairs of characters, and the Viterbi search for originals."""

    def __init__(self, words: dict[str, int], two: dict[str, int], total: int):
        self.words, self.total = words, max(1, total)
        self.log = {k: math.log(n / self.total) for k, n in two.items()}
        self.floor = math.log(0.3 / self.total)
        single: Counter = Counter()
        for k, n in two.items():
            for c in set(k):
                if c > "\x7f":
                    single[c] += n
        self.common = dict(single)
        # Characters of the model by their UTF-8 bytes with one byte, or the two after the first, open; frequent ones first.
        self.open: dict[tuple[int | None, ...], list[str]] = {}
        for c, _ in single.most_common():
            b = c.encode("utf-8", "surrogatepass")
            for i in range(len(b)):
                self.open.setdefault((*b[:i], None, *b[i + 1 :]), []).append(c)
            if len(b) == 3:
                self.open.setdefault((b[0], None, None), []).append(c)
        self.by_gaps: dict[str, tuple[int, str]] = {}
        for w, n in words.items():
            g = re.sub("[^\x00-\x7f]", LOST, w)
            if LOST not in w and n > self.by_gaps.get(g, (0, ""))[0]:
                self.by_gaps[g] = (n, w)
        self.judge = lru_cache(maxsize=100_000)(self._judge)

    def score(self, piece: str) -> float:
        """Nats of a piece; a byte order mark is no text and costs nothing."""
        piece = piece.replace(MARK, "")
        return sum(self.log.get(k, self.floor) for k in pairs(piece)) if piece else 0.0

    def _step(self, x: str, y: str) -> float:
        return self.log.get((x + y).translate(_CLASSES), self.floor) if x > "\x7f" or y > "\x7f" else 0.0

    def known(self, piece: str) -> float:
        """Nats for a word that the corpus knows."""
        return math.log1p(self.words.get(word(piece), 0)) if len(piece) <= WORD_LENGTH else 0.0

    def decode(self, data: list[int | None], encoding: str, stands: str = "") -> str | None:
        """The best reading of a byte lattice (None: a lost byte) in UTF-8 or GBK; None where there is none.

        stands: the characters as they stand, if each byte may be left as it is.
        """
        states: list[list[tuple[float, str]]] = [[] for _ in range(len(data) + 1)]
        states[0] = [(0.0, " ")]
        n = len(data)
        for i in range(n):
            if not states[i]:
                continue
            beam = sorted(states[i], reverse=True)[:BEAM]
            states[i] = []
            b = data[i]
            options: list[tuple[int, str]] = []
            if b is not None and b < 128:
                options.append((1, chr(b)))
            elif encoding == "utf-8":
                for size, lo, hi in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
                    part = tuple(data[i : i + size])
                    if len(part) < size or not (b is None or lo <= b <= hi):
                        continue
                    gaps = part.count(None)
                    if gaps == 0:
                        try:
                            options.append((size, bytes(part).decode("utf-8")))
                        except UnicodeDecodeError:
                            pass
                    else:
                        options += [(size, c) for c in self.open.get(part, ())[:READINGS]]
                # A byte that leads nowhere stays as it is or lost, at a price.
                options.append((1, stands[i] if stands else LOST))
            else:
                part = data[i : i + 2]
                if len(part) == 2 and None not in part:
                    try:
                        options.append((2, bytes(part).decode("gbk")))
                    except UnicodeDecodeError:
                        pass
            for size, c in options:
                for s, said in beam:
                    price = LOSS if c == LOST else SOUND if size == 1 and c > "\x7f" else 0.0
                    states[i + size].append((s + self._step(said[-1], c) - price, said + c))
        if not states[n]:
            return None
        return max((s + self._step(said[-1], " ") + self.known(said[1:]), said) for s, said in states[n])[1][1:]

    def originals(self, piece: str) -> Iterator[tuple[str, str, tuple[str, str] | None]]:
        """(kind, original, encodings): u for a decoded sequence of bytes, s for a change of single bytes from one encoding to another."""
        beyond = [c for c in piece if c > "\x7f"]
        highest = max(beyond)
        seen: dict[tuple, str] = {}
        for e in SINGLE:
            table = TO_BYTE[e]
            if all(c in table or c == LOST for c in beyond):
                seen.setdefault(tuple(ord(c) if c <= "\x7f" else table.get(c) for c in piece), e)
        for data, wrong in seen.items():
            if len(beyond) > 1:
                for s in ("utf-8", "gbk"):
                    if (o := self._lattice(data, s, piece)) is not None:
                        yield "u", o, None
            if None not in data:
                for e in SINGLE:
                    o = "".join(chr(b) if b < 128 else FROM_BYTE[e][b] for b in data)
                    if o != piece:
                        yield "s", o, (wrong, e)
        if highest >= "⺀" or any("Ͱ" <= c < "Ѐ" or "" <= c < "" for c in beyond):
            data = []
            for c in piece:
                if c == LOST:
                    data.append(None)
                    continue
                try:
                    data += c.encode("gb18030")
                except UnicodeEncodeError:
                    data.append(None)
            if (o := self._lattice(tuple(data), "utf-8")) is not None:
                yield "u", o, None

    def _lattice(self, data: tuple[int | None, ...], encoding: str, stands: str = "") -> str | None:
        if None in data:
            return self.decode(list(data), encoding)
        raw = bytes(data)
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            # A stretch may be garbled while its neighbours are sound, or lack a byte at its end.
            return self.decode(list(data), encoding, stands) if stands and encoding == "utf-8" and _SEQUENCE.search(raw) else None

    def fill(self, piece: str, least: int = 1) -> str | None:
        """A piece with its lost bytes, be they marks or question marks, filled in by the most frequent word that has letters beyond ASCII there."""
        for core in (piece.strip(_WORD_EDGE), piece.strip(_WORD_EDGE.replace("?", ""))):
            n, w = self.by_gaps.get(core.lower().replace("?", LOST), (0, ""))
            if n >= least and len(w) == len(core):
                filled = "".join(y if x in (LOST, "?") else x for x, y in zip(core, w, strict=True))
                if core[0] in (LOST, "?") and self.log.get(" " + w[0].upper(), self.floor) > self.log.get(" " + w[0], self.floor):
                    filled = filled[0].upper() + filled[1:]
                return piece.replace(core, filled, 1)
        return None

    def _judge(self, piece: str, rounds: int = ROUNDS) -> tuple[float, str, tuple[str, str] | None]:
        """(gain, original, encodings) of a piece: how much more probable its best original is; 0 and the piece itself if it is sound."""
        if LOST not in piece and max(piece) >= "⺀":
            # No encoding of one byte a character has these: only UTF-8 taken for GBK could read so.
            try:
                piece.encode("gb18030").decode("utf-8")
            except UnicodeError:
                return 0.0, piece, None
        here = self.words.get(word(piece), 0) if len(piece) <= WORD_LENGTH else 0
        if LOST in piece:
            filled = self.fill(piece)
            if filled is not None:
                return 2 * DOCUMENT_GAIN, filled, None
            best = max(((self.score(o) + self.known(o) - self.score(piece), o) for k, o, _ in self.originals(piece) if k == "u"), default=(0.0, piece))
            return 2 * DOCUMENT_GAIN, best[1], None
        two = pairs(piece)
        before = self.score(piece) + self.known(piece)
        best: tuple[float, str, tuple[str, str] | None] = (0.0, piece, None)
        for kind, o, encodings in self.originals(piece):
            if _UNUSUAL.search(o):
                # Text garbled twice: what comes out first may be no text yet.
                o = self._judge(o, rounds - 1)[1] if kind == "u" and rounds > 1 and not o.isascii() else o
                if _UNUSUAL.search(o):
                    continue
            n = self.words.get(word(o), 0) if len(o) <= WORD_LENGTH else 0
            gain = self.score(o) + self.known(o) - before
            if kind == "s":
                long = re.search("[^\x00-\x7f]{4,}", piece) is not None
                known = n >= WORD_COUNT and n >= WORD_RATIO * (here + 1)
                if not known and not (long and gain > 1.0 * len(two) and here < WORD_COUNT):
                    continue
                gain = max(gain, math.log((n + 1) / (here + 1)))
            elif here > n and here >= WORD_COUNT and gain < 3 * PIECE_GAIN:
                continue
            if gain > max(best[0], PIECE_GAIN):
                best = (gain, o.replace(MARK, ""), encodings)
        return best

    def restore(self, text: str) -> tuple[float, str]:
        """(gain, restored text); gain 0 and the text itself if nothing is garbled."""
        asked = [p for p in text.split() if _ASKED.search(p) and LOST not in p] if "?" in text else []
        if text.isascii() and not asked:
            return 0.0, text
        gains, repaired, changed, ways = 0.0, {}, set(), Counter()
        parts = dict.fromkeys(q for piece in pieces(text) for q in spans(piece) if not q.isascii())
        for p in parts:
            gain, o, encodings = self.judge(p)
            rounds = 1
            while gain and o != p and rounds < ROUNDS and not o.isascii():
                more, again = 0.0, ""
                for q in spans(o):
                    g, x = (0.0, q) if q.isascii() else self.judge(q)[:2]
                    more, again = more + g, again + x
                if not more or "".join(spans(o)) != o:
                    break
                o, rounds = again, rounds + 1
            if gain:
                gains += gain
                repaired[p] = o
                if encodings:
                    ways[encodings] += gain
                    changed.add(p)
        for p in asked:
            # Bytes lost to question marks leave no other trace than a word that is known.
            if p.isascii() and (o := self.fill(p, WORD_COUNT)) is not None:
                gains += 2 * DOCUMENT_GAIN
                repaired[p] = o
        if gains < DOCUMENT_GAIN:
            return 0.0, text
        if ways:
            # Pieces too short to tell go the way of the others.
            (wrong, right), _ = ways.most_common(1)[0]
            for p in parts:
                if len(p) <= 3 and (p in changed or p not in repaired):
                    repaired.pop(p, None)
                    if all(c <= "\x7f" or c in TO_BYTE[wrong] for c in p):
                        o = "".join(c if c <= "\x7f" else FROM_BYTE[right][TO_BYTE[wrong][c]] for c in p)
                        if self.words.get(word(o), 0) >= WORD_COUNT and not _UNUSUAL.search(o):
                            repaired[p] = o
                            changed.add(p)
        for p in sorted(repaired, key=len, reverse=True):
            text = re.sub(rf"(?<!\S){re.escape(p)}(?!\S)", repaired[p].replace("\\", r"\\"), text) if len(p) <= 3 and (p in changed or set(p) == {LOST}) else text.replace(p, repaired[p])
        return gains, text


#: A character of several bytes in UTF-8.
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: A question mark before a letter.
_ASKED = re.compile(r"\?[^\W\d_]")
#: Characters no original has: controls and the private area.
_UNUSUAL = re.compile("[\x00-\x1f\x7f-\x9f\ue000-\uf8ff\ufffd]")


def spans(piece: str) -> list[str]:
    """A long piece in parts, so that a garbled stretch is judged apart from its sound neighbours; a garbled byte order mark is a part of its own."""
    for mark in MARKS:
        if piece.startswith(mark) and piece != mark:
            return [mark, *spans(piece[len(mark) :])]
    if len(piece) <= WORD_LENGTH:
        return [piece]
    out, at = [], 0
    for m in re.finditer(r"[\x21-\x7e]{2,}", piece):
        out += [piece[at : m.start()], m[0]]
        at = m.end()
    out.append(piece[at:])
    return [x for x in out if x]


def fit(documents: DataFrame, most: dict[str, int] | None = None) -> Model:
    """The model of a table: its most frequent words and pairs, at most so many of each.

    The least count that keeps within the bound is read off a histogram of the counts
    (eight steps to a doubling: some 500 rows at most), so that nothing is sorted.
    """
    table = cut(counts(documents))
    totals = {r.kind: r.n for r in table.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    step, kept = F.floor(F.log2("n") * 8), {}
    for kind, bound in (most or {"w": MOST_WORDS, "p": MOST_PAIRS}).items():
        rows, least, there = table.filter((F.col("kind") == kind) & (F.col("n") >= LEAST)), 1 << 30, 0
        for r in sorted(bounded_rows(rows.groupBy(step.alias("step")).count(), 1000, "steps of counts"), reverse=True):
            there += r["count"]
            if there > bound:
                break
            least = r["step"]
        kept[kind] = {r.key: r.n for r in bounded_rows(rows.filter(step >= least).select("key", "n"), bound, "model")}
    return Model(kept["w"], kept["p"], totals.get("p", 0))


class _Once:
    """The model of a broadcast, built at most once per Python worker."""

    _built: dict[int, Model] = {}

    def __init__(self, shared):
        self.shared = shared

    def __call__(self) -> Model:
        # Workers are reused: a model is known by all it holds.
        key = xxhash.xxh3_128_intdigest(self.shared.value)
        if key not in _Once._built:
            _Once._built.clear()
            _Once._built[key] = Model(*pickle.loads(self.shared.value))
        return _Once._built[key]


def _search(model_of):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of()
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                gain, restored = model.restore(t)
                if gain:
                    rows.append((i, round(gain, 3), restored if LOST not in restored else None, restored))
            yield pd.DataFrame(rows, columns=["doc_id", "gain", "original", "restored"])

    return step


def garbled(documents: DataFrame) -> DataFrame:
    """``(doc_id, gain, original, restored)`` of the affected documents.

    original: the text with every garbled piece restored, null where a lost byte could
    not be; restored: as far as it could be. Null ids and null or empty texts give no
    rows; rows are judged one by one, so that repeated rows come out repeated.
    """
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    model = fit(docs)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps((model.words, {k: round(math.exp(v) * model.total) for k, v in model.log.items()}, model.total)))
    return docs.mapInPandas(_search(_Once(shared)), "doc_id bigint, gain double, original string, restored string")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents."""
    return garbled(pruned_table(spark, folder, "documents", ["doc_id", "text"])).select("doc_id").distinct()


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with the original text where it could be recovered."""
    return garbled(pruned_table(spark, folder, "documents", ["doc_id", "text"])).select("doc_id", "original").distinct()


QUERIES = {"p9_found": found, "p9_originals": originals}
ORACLE: dict[str, str] = {}
