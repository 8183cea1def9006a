"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

A source of share n of W in all is due one block in each window of W / n slots: its k-th block is released at
floor(k W / n) and has its deadline at ceil((k + 1) W / n). At every slot the released block with the earliest
deadline goes next. While it lasts, a source's blocks before any slot t differ from t n / W by less than one. The schedule repeats
every W slots, so at most one cycle is laid out, and no more of it than the blocks reach. Long cycles are laid out in segments of bounded size, each
starting from the blocks that the one before has given. A source that has run out leaves its slots empty,
and the others keep theirs, so their order and proportions stay; no row is dropped or repeated.
"""

from __future__ import annotations

import json
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfreq.operators.sampling import position
from corpusfreq.session import materialize

BLOCK_ROWS = 64
#: Slots of a segment of the cycle, and cells (slots times sources) up to which blocks before a slot are counted by source with the layout; beyond that places are counted from the rows.
SEGMENT, MAX_CELLS = 5_000, 2_000_000
CHUNK_ROWS, MAX_CHUNKS = 10_000, 50_000


def _least(k: str, n: str, cycle: int) -> str:
    return f"(({k} + 1) * {cycle} + {n} - 1) div {n}"


def cycle(spark: SparkSession, shares: list[int], slots: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """(slot, s, occ): of each slot of one cycle (or of its first `slots`) the source number and which of its blocks it is."""
    w, c = sum(shares), len(shares)
    end = min(w, slots) if slots else w
    n = f"array({', '.join(f'{x}L' for x in shares)})"
    given, parts = [0] * c, []
    for start in range(0, end, segment):
        stop = min(end, start + segment)
        pick = (f"array_min(filter(transform(acc.k, (k, i) -> if(k * {w} div {n}[i] <= t, struct({_least('k', n + '[i]', w)} AS d, i AS i), null)), x -> x IS NOT NULL)).i")
        fold = (f"aggregate(sequence({start}L, {stop - 1}L), named_struct('k', array({', '.join(f'{x}L' for x in given)}), 'out', CAST(array() AS array<int>)), "
                f"(acc, t) -> aggregate(array({pick}), acc, (a, p) -> named_struct('k', transform(a.k, (k, i) -> if(i = p, k + 1, k)), 'out', array_append(a.out, p)))).out")
        laid = spark.range(1).select(F.posexplode(F.expr(fold)).alias("slot", "s"))
        order = Window.partitionBy("s").orderBy("slot")  # of one segment
        base = F.get(F.array(*(F.lit(x) for x in given)), F.col("s"))
        part = laid.select((F.col("slot") + start).cast("long").alias("slot"), "s", (F.row_number().over(order) - 1 + base).cast("long").alias("occ"))
        if stop < end:
            part, _ = materialize(part, "cycle")
            for r in part.groupBy("s").agg(F.max("occ").alias("k")).collect():  # one row a source
                given[r["s"]] = r["k"] + 1
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def counted(cycle: DataFrame, sources: int) -> DataFrame:
    """The cycle with before: the blocks of every source before each slot. For cycles of at most MAX_CELLS cells, which fit in one task."""
    before = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return cycle.withColumn("before", F.array(*(F.coalesce(F.count(F.when(F.col("s") == i, 1)).over(before), F.lit(0)) for i in range(sources))))


def _order_key(id_col: str) -> Column:
    return F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit(""))


def mix(docs: DataFrame, shares: dict[str, int], default_share: int = 1, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with mix_slot (the Pfair slot of their block), mix_position (the block's place among all blocks, from 0) and mix_index (the row's
    place in its block).

    Rows of a source are taken in the order of md5(id), then id; repeated rows take neighbouring places. Null sources are a source of their own, with
    the default share, as have sources that `shares` doesn't name. Columns of the three names are replaced. An empty table stays empty.
    Shares are positive whole numbers; the longer the cycle that they add up to, the longer the layout takes, in proportion to its slots times sources.
    Sources, like shares, are few enough to be listed. A source is split into chunks by the order key, so its size doesn't matter.
    """
    spark = docs.sparkSession
    if default_share < 1 or any(x < 1 for x in shares.values()):
        raise ValueError("shares are positive whole numbers")
    out = [c for c in docs.columns if c.lower() not in ("mix_slot", "mix_position", "mix_index")]
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    found = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy("key").collect()  # one row a source
    if not found:
        zero = F.lit(0)
        return docs.limit(0).select(*out, zero.cast("long").alias("mix_slot"), zero.cast("long").alias("mix_position"), zero.alias("mix_index"))
    named = {"=" + k: v for k, v in shares.items()}
    share = [named.get(r["key"], default_share) for r in found]
    common = reduce(gcd, share)
    share = [x // common for x in share]
    w, total = sum(share), sum(r["n"] for r in found)
    blocks = [-(-r["n"] // block_rows) for r in found]
    per = max(CHUNK_ROWS, -(-total // MAX_CHUNKS))
    listed = json.dumps([{"key": r["key"], "s": i, "chunks": -(-r["n"] // per), "share": share[i]} for i, r in enumerate(found)])
    about = F.broadcast(  # one row a source
        spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<key: string, s: int, chunks: long, share: long>>")).alias("x")).select("x.*"))
    rows = docs.select(F.struct(*(F.col(c) for c in out)).alias("row"), key.alias("key"), _order_key(id_col).alias("h"), F.col(id_col).alias("id")).join(about, "key")
    place = F.conv(F.concat(F.lit("0"), F.substring("h", 1, 8)), 16, 10).cast("long")
    rows = rows.withColumn("chunk", (place * F.col("chunks") / F.lit(2**32)).cast("long"))
    sizes = docs.select(key.alias("key"), _order_key(id_col).alias("h")).join(about, "key").withColumn("chunk", (place * F.col("chunks") / F.lit(2**32)).cast("long")).groupBy("s", "chunk").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("s", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead")))  # at most MAX_CHUNKS rows and one a source
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("h", "id")) - 1
    ranked = rows.withColumn("rank", rank).join(offsets, ["s", "chunk"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    ranked = ranked.withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("turn", F.expr("block div share")).withColumn("occ", F.expr("block % share"))
    reach = max(-(-b * w // n) for b, n in zip(blocks, share))  # no block has a later deadline
    layout = cycle(spark, share, reach)
    if min(w, reach) * len(share) > MAX_CELLS:
        return _placed(ranked.join(layout, ["s", "occ"]), w, block_rows)
    laid = ranked.join(F.broadcast(counted(layout, len(share))), ["s", "occ"])
    limits, steps = F.array(*map(F.lit, map(int, blocks))), F.array(*map(F.lit, share))
    before = F.transform(F.arrays_zip(F.col("before").alias("b"), limits.alias("l"), steps.alias("n")), lambda x: F.least(x["l"].cast("long"), F.col("turn") * x["n"] + x["b"]))
    return laid.select("row.*", (F.col("turn") * w + F.col("slot")).alias("mix_slot"), F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + x).alias("mix_position"),
                       F.expr(f"CAST(rank % {block_rows} AS INT)").alias("mix_index"))


def _placed(laid: DataFrame, w: int, block_rows: int) -> DataFrame:
    """The same for layouts of any size: blocks' places are those of their slots among all slots in use."""
    rows, _ = materialize(laid.select("row", (F.col("turn") * w + F.col("slot")).alias("mix_slot"), F.expr(f"CAST(rank % {block_rows} AS INT)").alias("mix_index")), "mix")
    places = position(rows.select("mix_slot").distinct(), "mix_slot").withColumnRenamed("pos", "mix_position")
    return rows.join(places, "mix_slot").select("row.*", "mix_slot", F.col("mix_position").cast("long").alias("mix_position"), "mix_index")
