"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles gives K minima; bands of ROWS minima make candidate keys and the BITS low bits of each minimum,
packed into 64-bit words, estimate similarity by counting bits: with m of K lanes equal,
J ~ (m / K - 2^-b) / (1 - 2^-b), the chance of colliding low bits taken out. Candidates with an estimate below
threshold - SLACK (over five standard errors) go; the rest is verified on full shingle sets.

Texts with equal sets become one class first. Within a band key the members are compared with a hub, so a group of near copies costs about one comparison a
member. What hubs leave apart is compared pairwise in keys of up to PAIRWISE members. The members of larger keys, such as pages that share a template but no more, are
joined on the rare shingles of each set instead (prefix filter): sets that reach the bound share one of their n - ceil(bound n) + 1 rarest, so no link is lost, and
frequent shingles bring no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.operators.graph import connected_components
from corpusfreq.session import materialize

BANDS, ROWS, BITS = 48, 6, 2
K = BANDS * ROWS
LANES = 64 // BITS
PACKED = K // LANES
SLACK = 0.16
HUB_ROUNDS = 2
PAIRWISE = 64
_STEP = 1024
_rng = np.random.default_rng(20_24)
_MUL = (_rng.integers(1, 2**32, K, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_MIX = (_rng.integers(1, 2**32, K, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 2**32, K, dtype=np.uint64).astype(np.uint32)[:, None]


class _Words(dict):
    """64-bit hash of each word; emptied when it has grown to 300,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_hashes(own: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer than `size` words the whole sequence is the one shingle."""
    if not own:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for j in range(min(size, len(w))):
        h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(K, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), _STEP):
        h = x[a : a + _STEP][None, :] * _MUL
        h += _ADD
        h ^= h >> np.uint32(15)
        h *= _MIX
        np.minimum(least, h.min(1), out=least)
    return least


def _sketch(text: str | None, size: int, cache: dict) -> tuple[int, bytes | None, list[int] | None, list[int] | None]:
    """Set size, digest of the set, band keys and packed low bits."""
    own = shingle_hashes(words(text), size, cache)
    if not len(own):
        return 0, None, None, None
    least = minima(own)
    bands = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    low = (least & ((1 << BITS) - 1)).astype(np.uint64).reshape(PACKED, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return len(own), xxhash.xxh3_128_digest(own.tobytes()), bands, np.bitwise_or.reduce(low, 1).view(np.int64).tolist()


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_key, bands, bits) of every row; the last three are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                n, key, bands, bits = zip(*(_sketch(t, size, cache) for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "set_key", "bands", "bits"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures by bit counts."""
    odd = F.lit(0x5555555555555555)
    apart = sum((F.bit_count((x := a[k].bitwiseXOR(b[k])).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)) for k in range(PACKED)), F.lit(0))
    chance = 2.0**-BITS
    return (1 - apart / F.lit(float(K)) - chance) / (1 - chance)


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) of class representatives whose full shingle sets meet 100 * both >= percent * either. docs: (id, text), ids unique."""
    left, right = docs.select(F.col("id").alias("u"), F.col("text").alias("_a")), docs.select(F.col("id").alias("v"), F.col("text").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(text: str) -> set:
            w = words(text)
            return set(zip(*(w[j:] for j in range(size)))) if len(w) >= size else {tuple(w)}

        hub, held = None, set()
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if y != hub:  # rows mostly come sorted by hub
                        hub, held = y, own(y)
                    mine = own(x)
                    both = len(mine & held)
                    keep.append(100 * both >= percent * (len(mine) + len(held) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "_a", "_b")
    kind = docs.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"u {kind}, v {kind}")


def rare_partners(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of members (id, component) of different components that share a shingle that is among the rarest of both, as all pairs that reach percent do."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                sets = [shingle_hashes(words(t), size, cache).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    sets = texts.join(members.select("id"), "id", "left_semi").select("id", "text").mapInArrow(run, f"id {kind}, set array<long>")
    rows, _ = materialize(sets.select("id", F.size("set").alias("n"), F.explode("set").alias("h")), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    prefix = rows.join(often, "h").withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    prefix, _ = materialize(prefix.select("id", "h").join(members, "id"), "rare")
    other = prefix.select(F.col("id").alias("v"), "h", F.col("component").alias("_hub"))
    return prefix.join(other, "h").filter((F.col("component") < F.col("_hub"))).select(F.col("id").alias("u"), "v")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: links join texts with 100 * shared >= percent * all shingles.

    Null and empty texts, and those without words, have 0 shingles and link with nothing. Ids are taken as unique; a repeated row
    gives a repeated row of the same component. A null id stands alone with a null component. Extra columns aren't read. An empty table gives no rows.
    percent must be at least 80: below that the bands would lose pairs (at 80 a link escapes all bands with a chance of 5e-7).
    """
    if percent < 80:
        raise ValueError("BANDS and ROWS are laid out for 80 percent and more")
    spark = docs.sparkSession
    sketch, _ = materialize(sketches(docs, id_col, text_col, shingle), "sketches")
    some = sketch.filter("set_key IS NOT NULL AND id IS NOT NULL")
    classes, _ = materialize(some.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("id"), F.lit(True).alias("_own")), "id", "left_semi").select("id", "bands", "bits")
    # a repeated id keeps one row
    buckets = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).filter("hub < _last")
    members, _ = materialize(buckets.join(shared.select("band", "key"), ["band", "key"], "left_semi").distinct(), "members")
    live = members.select("id").distinct()
    bits, _ = materialize(reps.join(live, "id", "left_semi").dropDuplicates(["id"]).select("id", "bits"), "bits")
    texts, _ = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(live, "id", "left_semi").dropDuplicates(["id"]), "texts")
    least = percent / 100 - SLACK

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = bits.select(F.col("id").alias("u"), F.col("bits").alias("_x")), bits.select(F.col("id").alias("v"), F.col("bits").alias("_y"))
        return pairs.join(a, "u").join(b, "v").filter(estimate(F.col("_x"), F.col("_y")) >= least).select("u", "v")

    links, tried = None, None
    group = None  # (id, component) after the rounds so far
    for round_ in range(HUB_ROUNDS + 1):
        rows = members
        if group is not None:
            rows = members.join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
            apart = rows.groupBy("band", "key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi")
            rows = rows.join(apart, ["band", "key"]).drop("_hi")
            if rows.isEmpty():
                break
        if round_ < HUB_ROUNDS:
            # hub: first of the whole key, then first outside the least component; every member is compared with it
            outside = rows if group is None else rows.filter("component > _lo")
            hubs = outside.groupBy("band", "key").agg(F.min("id").alias("v"))
            pairs = rows.join(hubs, ["band", "key"]).filter("id <> v")
            pairs = (pairs if group is None else pairs.join(group.select(F.col("id").alias("v"), F.col("component").alias("_hub")), "v", "left")
                     .filter("component <> coalesce(_hub, v)")).select(F.col("id").alias("u"), "v")
        else:
            sizes = rows.groupBy("band", "key").agg(F.count("*").alias("_size"))
            rows, _ = materialize(rows.join(sizes, ["band", "key"]), "apart")
            few = rows.filter(F.col("_size") <= PAIRWISE)
            other = few.select("band", "key", F.col("id").alias("v"), F.col("component").alias("_hub"))
            pairs = few.join(other, ["band", "key"]).filter(F.col("component") < F.col("_hub")).select(F.col("id").alias("u"), "v")
            many = rows.filter(F.col("_size") > PAIRWISE).select("id", "component").distinct()
            if not many.isEmpty():
                pairs = pairs.unionByName(rare_partners(many, texts, shingle, percent))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti").join(tried.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti")
        pairs, _ = materialize(likely(pairs), "pairs")
        found, _ = materialize(verify(pairs, texts, shingle, percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        group = connected_components(links)
    joined = classes.join(group.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("_least")) if group is not None else classes.select("set_key", F.col("rep").alias("_least"))
    return (
        sketch.select("id", "n_shingles", "set_key").join(joined, "set_key", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("_least", "id").alias("component_id"), F.coalesce(F.col("_least") == F.col("id"), F.lit(True)).alias("kept"))
    )
