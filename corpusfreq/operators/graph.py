"""Connected components by alternating large-star and small-star steps, all of them joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.session import drop_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of an edge, component being the least id that links reach.

    Each round halves the depth of the trees, so rounds grow as the logarithm of the longest chain. Hot
    vertices split: the minimum is taken with partial aggregation and the join is left to AQE's skew
    handling. Nulls and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    now, path = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.expr("u <> v")).distinct()
        if src not in ("u", "v") else
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "components")
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds if before[0] else 0):
        after, fresh = materialize(_small_star(_large_star(now)), "components")
        drop_path(spark, path)
        now, path = after, fresh
        new = mark(now)
        if new == before:
            break
        before = new
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
