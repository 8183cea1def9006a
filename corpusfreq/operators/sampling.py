"""Ordered slices, first duplicates, and samples with fixed sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions.text import cue_prefix
from corpusfreq.session import materialize


def position(rows: DataFrame, order: str) -> DataFrame:
    """rows with pos from 0 in the order of a column, nulls first; ties take neighbouring places.

    The rows are written once in range partitions with the number of their partition, so that counts and places come from the same partitions;
    partitions are numbered within, and no row passes through a single task. A column pos is replaced.
    """
    names = [c for c in rows.columns if c.lower() != "pos"]
    cut = rows.select(F.struct(*(F.col(c) for c in names)).alias("row"), F.col(order).alias("key")).repartitionByRange("key").withColumn("part", F.spark_partition_id())
    cut, _ = materialize(cut, "ranges")
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    ahead = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row a partition
    inner = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return cut.withColumn("inner", inner).join(F.broadcast(ahead), "part").select("row.*", (F.col("inner") + F.col("ahead")).alias("pos"))


def ordered_slice(rows: DataFrame, order: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows start to stop (excluded) in the order of a column with distinct values, as it were a Python slice of 0 and positive places.

    Places are found on the column alone; its values at both ends, two at most, then filter the scan.
    """
    start = start or 0
    if stop is not None and stop <= start:
        return rows.limit(0)
    ends = {start, *([] if stop is None else [stop])}
    if ends == {0}:
        return rows
    at = {r["pos"]: r[order] for r in position(rows.select(order), order).filter(F.col("pos").isin(*ends)).collect()}
    if start and start not in at:
        return rows.limit(0)
    out = rows.filter(F.col(order) >= F.lit(at[start])) if start and at[start] is not None else rows
    return out.filter(F.col(order).isNull() | (F.col(order) < F.lit(at[stop])) if not start else F.col(order) < F.lit(at[stop])) if stop in at else out


def in_list_order(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the listed keys with place, that of their key in the list; keys that no row has are an error. The list is the caller's own, small and of distinct keys."""
    if len(set(wanted)) != len(wanted):
        raise ValueError("repeated keys")
    spark = rows.sparkSession
    listed = spark.createDataFrame(list(zip(wanted, range(len(wanted)))), f"`{key}` {rows.schema[key].dataType.simpleString()}, place int")
    found = rows.join(F.broadcast(listed), key)
    gone = listed.join(found.select(key).distinct(), key, "left_anti").limit(5).collect()
    if gone:
        raise KeyError([r[key] for r in gone])
    return found


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")


def stratified(rows: DataFrame, strata: list[str], size: int, order: Column) -> DataFrame:
    """`size` rows (all if there are fewer) with quotas by largest remainder (ties: the larger stratum, then by name), and within a stratum the first by
    `order`, usually a hash of the id with a seed. A sampling operator: its size is the feature."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    share = F.least(F.lit(size), F.col("_all")) * F.col("_n") / F.col("_all")
    quotas = counts.crossJoin(F.broadcast(total)).withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 9))
    one = Window.orderBy(F.desc("_rest"), F.desc("_n"), *strata)  # one row a stratum
    given = quotas.crossJoin(F.broadcast(quotas.agg((F.least(F.lit(size), F.max("_all")) - F.sum("_floor")).alias("_left")))).withColumn("_quota", F.col("_floor") + (F.row_number().over(one) <= F.col("_left")).cast("int"))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in strata]
    joined = rows.withColumn("_order", order).alias("r").join(F.broadcast(given.select(*strata, "_quota")).alias("q"), match).select("r.*", "_quota")
    return joined.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_order"))).filter("_rank <= _quota").drop("_order", "_quota", "_rank")


def random_cues(cues: DataFrame, id_col: str, order: Column, n: int = 3, within: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """n cues of each video, drawn by `order`, with pick 1..n by time. within: (id, clean), to draw only from cues that begin with words (prefix) which the video's clean text holds."""
    if within is not None:
        cues = cues.withColumn("prefix", cue_prefix(F.col(text_col))).join(within, id_col).filter(F.contains("clean", F.col("prefix"))).drop("clean")
    drawn = cues.withColumn("_k", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).filter(F.col("_k") <= n).drop("_k")
    return drawn.withColumn("pick", F.row_number().over(Window.partitionBy(id_col).orderBy("start", text_col)))
