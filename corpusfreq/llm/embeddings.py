"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance R = 2 - 2c. After a rotation they are split
into BLOCKS low-dimensional blocks; by the pigeonhole principle two near vectors are within R * (dimensions of the block / all) in at
least one block. The rotation deals the principal axes of a bounded sample out to the blocks in turn, so that each block starts with a wide one (any rotation is right; this one
prunes). Each block is range-joined: slabs as wide as the radius along its first axis, each against itself and the next, in
chunks of bounded size; an axis that is narrow against the radius isn't cut. Candidates of all blocks are verified exactly (double precision, original vectors); a pair counts in
the first block that proposes it. Tasks return links a vector and a spanning forest, never all pairs. Vectors that are equal
up to their bits become one class first. Vectors of different lengths are joined apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.operators.graph import connected_components
from corpusfreq.session import materialize

BLOCKS = 4
CHUNK = 32_768
BROADCAST_ROWS = 50_000
SAMPLE, SAMPLE_CELLS, SAMPLED_LENGTHS = 20_000, 4_000_000, 8
_TILE = 512
_EPS, _SLACK = 1e-9, 1e-5  # of the budgets; of float32 products against them


@cache
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random rotation, for lengths without a sample."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def splits(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(cuts.tolist(), cuts[1:].tolist()))


def principal(x: np.ndarray, blocks: int) -> np.ndarray:
    """Principal axes of unit vectors as columns, the k-th widest leading or following in block k modulo blocks."""
    axes = np.linalg.eigh(np.atleast_2d(np.cov(x.T)) if len(x) > 1 else np.eye(x.shape[1]))[1][:, ::-1]
    parts = splits(x.shape[1], blocks)
    order = [[] for _ in parts]
    free = [b - a for a, b in parts]
    k, at = 0, 0
    while k < x.shape[1]:
        if free[at]:
            order[at].append(k)
            free[at] -= 1
            k += 1
        at = (at + 1) % len(parts)
    return np.ascontiguousarray(axes[:, [k for own in order for k in own]])


class Space:
    """Rotation, blocks and radii for one length; wide: which blocks are cut into slabs."""

    def __init__(self, dim: int, blocks: int, cosine: float, sample: np.ndarray | None) -> None:
        self.parts = splits(dim, blocks)
        self.turn = rotation(dim) if sample is None else principal(sample, blocks)
        self.budget = [(2 - 2 * cosine) * (b - a) / dim + _EPS for a, b in self.parts]
        self.radius = [float(np.sqrt(x)) for x in self.budget]
        self.wide = [False] * len(self.parts)
        if sample is not None:
            first = (sample @ self.turn)[:, [a for a, _ in self.parts]]
            span = np.quantile(first, 0.95, axis=0) - np.quantile(first, 0.05, axis=0)
            self.wide = [bool(s > 3 * r) for s, r in zip(span, self.radius)]

    def slabs(self, x: np.ndarray) -> np.ndarray:
        first = x @ self.turn[:, [a for a, _ in self.parts]]
        cut = np.floor(first / self.radius)
        return np.where(self.wide, cut, 0).astype(np.int32)


def _unit(raw: list[bytes], kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares nor sums overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Forest:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def pair_chunks(x: np.ndarray, y: np.ndarray | None, block: int, cosine: float, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (in x; in y, or for None later in x) whose cosine reaches the bound and whose first block within budget is `block`.

    Products in single precision, with slack, only pick out pairs; which blocks hold a pair is told by one formula, squared differences in double precision."""
    rx = x @ space.turn
    ry = rx if y is None else y @ space.turn
    a, b = space.parts[block]
    one = np.ones
    # |p - q|^2 <= budget  <=>  p.q - |q|^2 / 2 + (budget - |p|^2) / 2 >= 0, a product of vectors longer by two
    half = [(r[:, a:b] ** 2).sum(1) / 2 for r in (rx, ry)]
    left = np.c_[rx[:, a:b], one(len(rx)), (space.budget[block] + _SLACK) / 2 - half[0]].astype(np.float32)
    right = np.ascontiguousarray(np.c_[ry[:, a:b], -half[1], one(len(ry))].astype(np.float32).T)
    other = x if y is None else y
    for i in range(0, len(x), _TILE):
        for j in range(i if y is None else 0, len(other), _TILE):
            hit = left[i : i + _TILE] @ right[:, j : j + _TILE] >= 0
            if not hit.any():
                continue
            p, q = np.divmod(np.flatnonzero(hit), hit.shape[1])
            p, q = p + i, q + j
            if y is None:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 1 << 16):
                u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                good = np.einsum("ij,ij->i", x[u], other[v]) >= cosine
                u, v = u[good], v[good]
                for k in range(block, -1, -1):  # this block has it, and no earlier one
                    c, d = space.parts[k]
                    near = ((rx[u, c:d] - ry[v, c:d]) ** 2).sum(1) <= space.budget[k]
                    keep = near if k == block else ~near
                    u, v = u[keep], v[keep]
                if len(u):
                    yield u, v


def _spaces(vectors: DataFrame, blocks: int, cosine: float) -> dict[int, Space]:
    """Spaces of the commonest lengths, from a sample of at most SAMPLE vectors and SAMPLE_CELLS components of each, drawn by hash."""
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(SAMPLED_LENGTHS).collect()
    out = {}
    for r in sizes:
        most = min(SAMPLE, SAMPLE_CELLS // max(1, r["d"]))
        if r["d"] > 1024:
            continue
        share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(2.0**53)
        got = vectors.filter((F.size("v") == r["d"]) & (share <= most / r["count"])).select("v").limit(2 * most).collect()  # the choice sets the speed, not the result
        if got:
            x = np.array([g["v"] for g in got], np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            out[r["d"]] = Space(r["d"], blocks, cosine, x / np.sqrt((x * x).sum(1, keepdims=True)))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links join vectors of equal length and cosine >= `cosine`.

    Null or zero vectors, empty ones, and those with null or non-finite components, link with nothing; nor do vectors of different lengths.
    Ids are taken as unique; a repeated row counts as another vector of the same id. A null id links with nothing.
    Other columns aren't read. An empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    form = np.float32 if single else np.float64
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    kind = narrow.schema["id"].dataType.simpleString()
    fine = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    every = narrow.select("id", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v"))
    spaces = _spaces(every.filter("v IS NOT NULL"), blocks, cosine)

    def space_of(dim: int) -> Space:
        if dim not in spaces:
            spaces[dim] = Space(dim, blocks, cosine, None)
        return spaces[dim]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of each vector, its length and its slab in each block."""
        for b in batches:
            v = b.column(1)
            sizes = np.array([n or 0 for n in pc.list_value_length(v).to_pylist()], np.int64)
            raw: list = [None] * b.num_rows
            slabs: list = [None] * b.num_rows
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(form).reshape(-1, dim) + form(0)
                bits = [r.tobytes() for r in x]
                for k, r, s in zip(rows.tolist(), bits, space_of(dim).slabs(_unit(bits, form)).tolist()):
                    raw[k], slabs[k] = r, s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(slabs, pa.list_(pa.int32()))], ["id", "raw", "slabs"])

    packed, _ = materialize(every.mapInArrow(pack, f"id {kind}, raw binary, slabs array<int>"), "vectors")
    classes, _ = materialize(packed.filter("raw IS NOT NULL").groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("slabs").alias("slabs")), "vector-classes")
    cells = classes.select(F.col("rep").alias("id"), "n", "raw", F.length("raw").alias("bytes"), F.posexplode("slabs").alias("block", "slab"))
    # slabs of more than `chunk` vectors fall into chunks; the sizes are few numbers a block and slab
    per, _ = materialize(cells.groupBy("bytes", "block", "slab").agg(F.count("*").alias("_n")), "slabs")
    small = F.broadcast if per.count() <= BROADCAST_ROWS else lambda df: df
    cells = cells.join(small(per), ["bytes", "block", "slab"]).withColumn("cut", F.ceil(F.col("_n") / F.lit(chunk))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")).drop("_n")
    ahead = per.select("bytes", "block", (F.col("slab") - 1).alias("slab"), F.ceil(F.col("_n") / F.lit(chunk)).alias("next"))
    behind = per.select("bytes", "block", (F.col("slab") + 1).alias("slab"), F.ceil(F.col("_n") / F.lit(chunk)).alias("last"))
    cells = cells.join(small(ahead), ["bytes", "block", "slab"], "left").join(small(behind), ["bytes", "block", "slab"], "left")
    # a task compares chunk `part` of slab with chunk `mate` of the same slab (step 0, part <= mate) or of the next (step 1)
    with_own = cells.withColumn("m", F.explode(F.sequence(F.lit(0), (F.col("cut") - 1).cast("int")))).select(
        "id", "n", "raw", "bytes", "block", "slab", F.lit(0).alias("step"),
        F.least("part", "m").alias("a"), F.greatest("part", "m").alias("b"), (F.col("part") > F.col("m")).alias("right"))
    as_left = cells.filter("next IS NOT NULL").withColumn("m", F.explode(F.sequence(F.lit(0), (F.col("next") - 1).cast("int")))).select(
        "id", "n", "raw", "bytes", "block", "slab", F.lit(1).alias("step"), F.col("part").alias("a"), F.col("m").alias("b"), F.lit(False).alias("right"))
    as_right = cells.filter("last IS NOT NULL").withColumn("m", F.explode(F.sequence(F.lit(0), (F.col("last") - 1).cast("int")))).select(
        "id", "n", "raw", "bytes", "block", (F.col("slab") - 1).alias("slab"), F.lit(1).alias("step"), F.col("m").alias("a"), F.col("part").alias("b"), F.lit(True).alias("right"))
    tasks = with_own.unionByName(as_left).unionByName(as_right)
    keys = ["bytes", "block", "slab", "step", "a", "b"]

    def compare(group: pa.Table) -> pa.Table:
        block, step = group["block"][0].as_py(), group["step"][0].as_py()
        alone = step == 0 and group["a"][0].as_py() == group["b"][0].as_py()
        group = group.sort_by("id")
        side = np.array(group["right"].to_pylist(), bool)
        ids, n, raw = group["id"].to_pylist(), np.array(group["n"].to_pylist(), np.int64), group["raw"].to_pylist()
        left = np.flatnonzero(~side) if not alone else np.arange(len(ids))
        right = left if alone else np.flatnonzero(side)
        links, forest, edges = np.zeros(len(ids), np.int64), _Forest(), []
        if len(left) and len(right):
            x = _unit([raw[k] for k in left], form)
            y = None if alone else _unit([raw[k] for k in right], form)
            for u, v in pair_chunks(x, y, block, cosine, space_of(x.shape[1])):
                u, v = left[u], right[v]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                for p, q in zip(u.tolist(), v.tolist()):
                    if forest.join(p, q):
                        edges.append((ids[p], ids[q]))
        hit = np.flatnonzero(links)
        kinds = group["id"].type
        return pa.table({
            "id": pa.array([ids[k] for k in hit] + [u for u, _ in edges], kinds),
            "mate": pa.array([None] * len(hit) + [v for _, v in edges], kinds),
            "links": pa.array(links[hit].tolist() + [0] * len(edges), pa.int64())})

    found, _ = materialize(tasks.groupBy(*keys).applyInArrow(compare, f"id {kind}, mate {kind}, links long"), "links")
    counts = found.filter("mate IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    group = connected_components(found.filter("mate IS NOT NULL").select(F.col("id").alias("u"), F.col("mate").alias("v")))
    known = classes.select("raw", "rep", "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("least"))
    return packed.select("id", "raw").join(known, "raw", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"),
        F.coalesce(F.col("least") == F.col("id"), F.lit(True)).alias("kept"))
