"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared in lower case with one blank for each run of other than letters and digits. An item of m
characters may differ from a passage by e = RATE * m edits; then they share at least m - q + 1 - q * e
q-grams, all on diagonals that span at most e. q is Q, or SHORT_Q for items so short that this would be none. Shared q-grams are counted in diagonal bands of width 2E that overlap
by E > e; bands that reach the bound are verified by banded alignment of the whole item.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q, SHORT_Q = 8, 5
RATE = 0.1
BLOCK_CHARS = 2_000_000
_WINDOW = 1024
_LOOK_BITS = 22


def _code(c: int) -> int:
    """Compared form of a character: its lower case if that is one character; 32 for other than letters, marks and digits."""
    x = chr(c)
    low = x.lower()
    return 32 if not (x.isalnum() or unicodedata.category(x)[0] == "M") else ord(low) if len(low) == 1 else c


_LATIN = np.array([_code(c) for c in range(256)], np.uint8)  # their lower cases are below 256


@cache
def _table() -> np.ndarray:
    """Compared form of every code point; surrogates separate."""
    codes = np.fromiter((_code(c) if not 0xD800 <= c < 0xE000 else 32 for c in range(0x110000)), np.uint32, 0x110000)
    codes.setflags(write=False)
    return codes


def _codes(text: str) -> np.ndarray:
    try:
        return _LATIN[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return _table()[c]


def _kept(c: np.ndarray) -> np.ndarray:
    """Which characters stay: words, and the first of each run of others after a word."""
    word = c != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    if len(keep) and (last := np.flatnonzero(word)).size:
        keep[last[-1] + 1 :] = False
    return keep


def normal(text: str | None) -> np.ndarray:
    """Compared characters."""
    if not text:
        return np.zeros(0, np.uint8)
    c = _codes(text)
    return c[_kept(c)]


def places(text: str) -> np.ndarray:
    """Position in the text of each compared character."""
    return np.flatnonzero(_kept(_codes(text)))


def _grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """q-grams of the characters folded to bytes, so that equal q-grams have equal values."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = a if a.dtype == np.uint8 else (a ^ (a >> 8) ^ (a >> 16)).astype(np.uint8)
    two = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    if q == SHORT_Q:
        return four[:-1].astype(np.uint64) | b[4:].astype(np.uint64) << np.uint64(32)
    return four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _LOOK_BITS)


def align(item: np.ndarray, region: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best passage of region that aligns with the item on diagonals low <= start - 0 < low + width,
    within `most` edits; ties go to the first end. Positions are those in region."""
    n, big = len(region), 1 << 40
    j = np.arange(width + 1)
    step = j.astype(np.int64) << 32
    inf = np.int64(big) << 10
    at = low + j  # column of row 0: alignments may start anywhere in the band
    row = np.where((at >= 0) & (at <= n), np.maximum(at, 0), inf)
    for i, c in enumerate(item, 1):
        at = low + i + j
        ok = (at >= 0) & (at <= n)
        same = np.zeros(width + 1, bool)
        inside = (at >= 1) & (at <= n)
        same[inside] = region[at[inside] - 1] == c
        new = np.where(inside, row + np.where(same, 0, np.int64(1) << 32), inf)  # along the diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + (np.int64(1) << 32))  # item character without partner
        new = np.where(ok, new, inf)
        row = np.minimum.accumulate(new - step) + step  # region character without partner
        row = np.where(ok, row, inf)
        if (int(row.min()) >> 32) > most:
            return None
    best = int(row.argmin())
    best = int(np.flatnonzero((row >> 32) == (row[best] >> 32))[0])
    edits, start = int(row[best] >> 32), int(row[best] & 0xFFFFFFFF)
    return (edits, start, int(low + len(item) + best)) if edits <= most else None


class Index:
    """q-grams of a block of items. edits: budget of each item."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE) -> None:
        self.words: list[tuple[object, re.Pattern]] = []
        self.edits: dict = {}
        long, short = [], []
        for key, text in items:
            a = normal(text)
            self.edits[key] = e = int(len(a) * rate)
            if len(a) - Q + 1 - Q * e >= 1:
                long.append((key, a))
            elif e:
                short.append((key, a))
            elif len(a):
                self.words.append((key, re.compile(r"(?<!\S)" + re.escape("".join(map(chr, a))) + r"(?!\S)")))
        self.parts = [_Part(part, q, rate) for part, q in ((long, Q), (short, SHORT_Q)) if part]

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, start, end, edits) of passages, positions being those in the text; overlapping passages of one item count once, the best."""
        a = normal(text)
        found = [x for part in self.parts for x in part.find(a)]
        hits = [(k, m.start(), m.end(), 0) for k, p in self.words for m in p.finditer("".join(map(chr, a)))] if self.words and len(a) else []
        if not found and not hits:
            return []
        at = places(text)
        return [(k, int(at[s]), int(at[e - 1]) + 1, d) for k, s, e, d in hits + sorted(found, key=lambda x: x[1])]


class _Part:
    """Items that share a q."""

    def __init__(self, items: list[tuple[object, np.ndarray]], q: int, rate: float) -> None:
        self.q, self.ids, self.texts = q, [k for k, _ in items], [a for _, a in items]
        self.length = np.array([len(a) for a in self.texts], np.int64)
        self.edits = (self.length * rate).astype(np.int64)
        self.bound = self.length - q + 1 - q * self.edits
        if self.bound.min() < 1:
            raise ValueError(f"a rate of {rate} leaves no common {q}-gram")
        own = [_grams(a, q) for a in self.texts]
        grams = np.concatenate(own)
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own])
        order = np.argsort(grams, kind="stable")
        self.keys, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.look = np.zeros(1 << _LOOK_BITS, bool)
        self.look[_slot(grams)] = True

    def find(self, a: np.ndarray) -> list[tuple[object, int, int, int]]:
        """The same in compared characters."""
        if len(a) < self.q:
            return []
        pieces = 1 << 16  # long texts in pieces that overlap by more than any passage
        reach = int((self.length + self.edits).max()) + self.q
        found: list[tuple[int, int, int, int]] = []
        for lo in range(0, max(1, len(a) - reach), pieces):
            found += self._piece(a[lo : lo + pieces + reach], lo)
        best: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, start, end, edits in sorted(set(found), key=lambda x: (x[0], x[3], x[1])):
            own = best.setdefault(k, [])
            at = bisect_left(own, (start,))  # passages kept so far don't overlap, so the neighbours tell
            if not (at < len(own) and own[at][0] < end) and not (at and own[at - 1][1] > start):
                own.insert(at, (start, end, edits, k))
        return [(self.ids[k], s, e, d) for own in best.values() for s, e, d, k in own]

    def _piece(self, a: np.ndarray, shift: int) -> list[tuple[int, int, int, int]]:
        h = _grams(a, self.q)
        pos = np.flatnonzero(self.look[_slot(h)])
        if len(pos) < self.bound.min():
            return []
        k = np.minimum(np.searchsorted(self.keys, h[pos]), len(self.keys) - 1)
        true = self.keys[k] == h[pos]
        pos, k = pos[true], k[true]
        if len(pos) < self.bound.min():
            return []
        times = self.count[k]
        pos = np.repeat(pos, times)
        entry = np.repeat(self.first[k], times) + np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times)
        item, diagonal = self.item[entry], pos - self.place[entry]
        # items that reach their bound in two neighbouring windows of the text
        n, windows = len(self.ids), len(a) // _WINDOW + 2
        wide = max(1, -(-int((self.length + self.edits).max()) // _WINDOW))
        per = np.bincount(item * windows + pos // _WINDOW, minlength=n * windows).reshape(n, windows)
        total = np.cumsum(np.pad(per, ((0, 0), (1, wide))), 1)
        near = (total[:, wide + 1 :] - total[:, : -wide - 1]) >= self.bound[:, None]
        live = near.copy()
        for j in range(1, wide + 1):
            live[:, j:] |= near[:, :-j]
        pick = live[item, pos // _WINDOW]
        item, diagonal, place = item[pick], diagonal[pick], self.place[entry[pick]]
        if not len(item):
            return []
        band = diagonal // (self.edits[item] + 1) + 2**20
        key = item * 2**32 + band
        out: list[tuple[int, int, int, int]] = []
        for one, spot, own in self._full(np.concatenate([key, key - 1]), np.tile(diagonal, 2), np.tile(place, 2)):
            i = one >> 32
            e = int(self.edits[i]) + 1
            low = ((one & 0xFFFFFFFF) - 2**20) * e
            if any(k == i and low <= start - shift < low + 2 * e for k, start, _, _ in out[-2:]):
                continue  # the neighbouring band holds the same passage
            d, n = spot[own.argmax()], len(self.texts[i])  # its commonest diagonal
            if d >= 0 and np.array_equal(a[d : d + n], self.texts[i]):
                out.append((i, shift + int(d), shift + int(d) + n, 0))
            elif got := align(self.texts[i], a, low, 2 * e, int(self.edits[i])):
                out.append((i, shift + got[1], shift + got[2], got[0]))
        return out

    def _full(self, key: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bands in which as many different q-grams of the item stand as its bound asks for, with their diagonals and how often each occurs."""
        keys, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        enough = counts >= self.bound[keys >> 32]
        pick = enough[inverse]
        key, diagonal, place = key[pick], diagonal[pick], place[pick]
        order = np.lexsort((place, key))
        key, diagonal, place = key[order], diagonal[order], place[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for s, e in zip(starts, [*starts[1:], len(key)]):
            if 1 + np.count_nonzero(place[s + 1 : e] != place[s : e - 1]) >= self.bound[int(key[s]) >> 32]:
                yield int(key[s]), *np.unique(diagonal[s:e], return_counts=True)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of blocks of about BLOCK_CHARS characters, so that what is broadcast doesn't grow with the items."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''").distinct()
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield Index([(r["id"], r["text"]) for r in sorted(part.collect(), key=lambda r: (str(r["id"]), r["text"]))])


def passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, end, edits) of each passage of a text that an item matches within its edit budget.

    start and end are positions in the text. Items are found as wholes, not by parts of them. Null and empty texts or items match nothing; items shorter than Q, characters compared, match as whole words without edits;
    repeated rows of either side repeat their passages once an item id and text; no items or documents: no rows. No shuffle: blocks of items are broadcast.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = narrow.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, start long, end long, edits int"
    item_type = to_arrow_type(items.schema[item_col].dataType)
    parts = []
    for index in _blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(n, *x) for n, t in enumerate(b.column(1).to_pylist()) for x in shared.value.find(t)]
                n, *found = zip(*rows) if rows else ((),) * 5
                found = [pa.array(x, t) for x, t in zip(found, (item_type, pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n, pa.int64())), *found], ["id", "item", "start", "end", "edits"])

        parts.append(narrow.mapInArrow(run, schema))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, columns as they were, whose text no item matches. No shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for index in _blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
