"""Line deduplication by pairwise alignment.

Overlapping documents are found through the hashes of runs of neighbouring lines: the shortest run from each line,
and the shortest up to each line, that has `min_words` words. Each run that more than one document holds links its later
documents to the first one that holds it, so a run costs one pair a document however common it is, and since such runs
cover every block of `min_words` words, each block is compared with a document that holds it. Each pair is aligned by
patience diff (lines unique in both, longest increasing run, again between the anchors); runs that both hold but the alignment
placed elsewhere, such as moved or repeated blocks, are added.
Common blocks of at least `min_words` words are deleted from the later document; order is that of the ids.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusfreq.session import materialize

MIN_WORDS = 10
DEPTH = 24
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by first index, whose second index rises."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b), rising in both. Ends are matched first, then lines unique in both; a
    stretch without such a line is aligned by the k-th occurrences of its lines. Gaps are aligned again, DEPTH times at most, so that
    the work stays in proportion to the lines."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, depth = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1 or depth == DEPTH:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        once = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
        if not once:
            places: dict[int, list[int]] = {}
            for j in range(b1 - 1, b0 - 1, -1):
                places.setdefault(b[j], []).append(j)
            once = [(i, at.pop()) for i in range(a0, a1) if (at := places.get(a[i]))]
            if not once:
                continue
        run = _increasing(once)
        found += run
        cuts = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        todo += [(i + 1, i2, j + 1, j2, depth + 1) for (i, j), (i2, j2) in zip(cuts, cuts[1:]) if i2 > i + 1 and j2 > j + 1]
    return sorted(found)


def spans(n: np.ndarray, w: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest runs of neighbouring lines from each line, and up to each line, that have min_words words.
    n: line numbers, rising within a document; w: words, at least 1. Such runs cover each longer run of min_words words."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.r_[True, (np.diff(n) != 1) | (np.diff(doc) != 0)]
    block = np.cumsum(begins) - 1
    low = np.flatnonzero(begins)
    high = np.r_[low[1:], len(n)]
    total = np.r_[0, np.cumsum(w, dtype=np.int64)]
    at = np.arange(len(n))
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at)
    down, up = end <= high[block], start >= low[block]
    both = np.unique(np.r_[np.c_[at[down], end[down]], np.c_[start[up], at[up] + 1]], axis=0)
    return both[:, 0], both[:, 1]


def run_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each run."""
    lines, key = h.view(np.uint64), np.zeros(len(start), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        on = np.flatnonzero(start + k < end)
        key[on] = key[on] * FACTOR + lines[start[on] + k]
    return key.view(np.int64)


def _common_runs(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], min_words: int) -> set[int]:
    """Line numbers of `later` in runs of min_words words that `earlier` holds too."""
    words = {h: w for _, h, w in later}
    sides = [later, [(n, h, words[h]) for n, h in earlier if h in words]]
    found = []
    for side in sides:
        n, w, h = np.array([x[0] for x in side]), np.array([x[2] for x in side]), [x[1] for x in side]
        found.append([(s, e, tuple(h[s:e])) for s, e in zip(*(x.tolist() for x in spans(n, w, np.zeros(len(n), np.int64), min_words)))])
    held = {x for _, _, x in found[1]}
    return {later[i][0] for s, e, x in found[0] if x in held for i in range(s, e)}


def common_blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], min_words: int) -> set[int]:
    """Line numbers of `later` (number, hash, words) in common blocks of at least min_words words. earlier: (number, hash).

    One patience alignment, then the runs that both hold but the alignment placed elsewhere (moved or repeated blocks)."""
    pool = {h for _, h in earlier}
    left = [x for x in later if x[1] in pool]
    own = {h for _, h, _ in left}
    base = [x for x in earlier if x[1] in own]
    drop: set[int] = set()
    block: list[tuple[int, int, int]] = []
    for i, j in [*patience([h for _, h, _ in left], [h for _, h in base]), (-1, -1)]:
        n, m = (left[i][0], base[j][0]) if i >= 0 else (-1, -1)
        if block and (n, m) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(w for _, _, w in block) >= min_words:
                drop.update(k for k, _, _ in block)
            block = []
        block.append((n, m, left[i][2] if i >= 0 else 0))
    if len(drop) < len(left):
        drop |= _common_runs(left, base, min_words)
    return drop


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, n, h, w) of each line that holds a word: its number among such lines and among all, hash and number of words."""
    full = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, n: F.struct(n.alias("n"), x.alias("line"))), lambda x: x["line"].rlike(r"\S"))
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(full).alias("k", "x")).select("id", "k", "x.n", "x.line")
    words = F.size(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    return lines.select("id", "k", "n", F.xxhash64("line").alias("h"), words.alias("w")).filter("w > 0 AND id IS NOT NULL")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, cut): the line numbers, from 0, that each later document loses. Documents that lose nothing aren't listed.

    Lines without a word are passed over: they neither part a block nor are they cut.
    A null text has no lines; rows that repeat an id are one document (its first text by order). An empty table gives no rows.
    """
    once = _lines(docs, id_col, text_col).groupBy("id", "k").agg(F.min(F.struct("h", "w", "n")).alias("x")).select("id", "k", "x.n", "x.h", "x.w")
    lines, _ = materialize(once, "lines")
    held = lines.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h")
    sequence = lines.join(held, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "h", "w", "n"))).alias("seq"))
    sequence, _ = materialize(sequence, "sequences")
    kind = lines.schema["id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, h, w = (b.column(1).flatten().field(c).to_numpy(zero_copy_only=False) for c in ("k", "h", "w"))
            doc = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            start, end = spans(k, w, doc, min_words)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[start])), pa.array(run_keys(h, start, end))], ["id", "key"])

    runs, _ = materialize(sequence.select("id", "seq").mapInArrow(keys, f"id {kind}, key long"), "runs")
    first = runs.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
    pairs = runs.join(first, "key").filter("id > first").select("id", "first").distinct()
    both = (pairs.select("id", "first").join(sequence.withColumnRenamed("seq", "later"), "id")
            .join(sequence.select(F.col("id").alias("first"), F.transform("seq", lambda x: F.struct(x["k"].alias("k"), x["h"].alias("h"))).alias("earlier")), "first").select("id", "later", "earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = []
            for later, earlier in zip(b.column(1), b.column(2)):
                x, y = later.values, earlier.values
                at = x.field("k").to_pylist()
                n = dict(zip(at, x.field("n").to_pylist()))
                cuts.append(sorted(n[k] for k in common_blocks(
                    list(zip(at, x.field("h").to_pylist(), x.field("w").to_pylist())),
                    list(zip(y.field("k").to_pylist(), y.field("h").to_pylist())), min_words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cuts, pa.list_(pa.int32()))], ["id", "cut"])

    found = both.mapInArrow(run, f"id {kind}, cut array<int>").filter("size(cut) > 0")
    return found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut")).withColumnRenamed("id", id_col)


@F.arrow_udf(StringType())
def _without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers; empty if only white space is left."""

    def rest(text: str, cut: list[int]) -> str:
        gone = set(cut)
        out = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        return out if out.strip(" \t\n\x0b\f\r") else ""

    return pa.array([t.as_py() if not t.is_valid else rest(t.as_py(), c.as_py()) for t, c in zip(texts, cuts)], pa.string())


def remove_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, columns as they were, without their duplicate lines; length_col, if given, gets the new text's length.

    Only documents that lose lines are rewritten; texts of which nothing but white space is left become empty, rows are never dropped.
    """
    cuts, _ = materialize(duplicate_lines(docs, id_col, text_col, min_words), "cuts")
    names = docs.columns
    rest = [c for c in names if c != text_col]
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in rest), F.lit(0)).alias("rest"))  # no name can clash
    # by shuffle at any size: what is cut grows with the documents
    marked = packed.join(cuts.select(F.col(id_col).alias("of"), "cut").hint("merge"), F.col("id") == F.col("of"), "left")
    # texts that lose nothing don't travel; as it passes for nondeterministic, a filter on the new text reads what was made, else it is made again in a second Python worker a task
    rest_of = _without.asNondeterministic()(F.when(F.col("cut").isNotNull(), F.col("text")), F.col("cut"))
    out = marked.withColumn("new", F.when(F.col("cut").isNull(), F.col("text")).otherwise(rest_of))
    return out.select(*(
        F.col("new").alias(text_col) if c == text_col else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col("rest")[c].alias(c) for c in names))
