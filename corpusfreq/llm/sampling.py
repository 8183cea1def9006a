"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id's text, modulo mod; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1))


def bounded_rows(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, class_col: str, per_class: int, max_chars: int) -> DataFrame:
    """Up to per_class rows (text, class) of each class, those of least hash of the id among texts of at most max_chars.

    classes: (id_col, class_col), one row an id. The choice is made on ids and lengths only. Classes are counted, and a bound on the hash, drawn from the
    count, leaves about per_class ids of each (six standard deviations more, so that a class falls short with a chance of 1e-9); only these are ranked, so a class may
    hold most rows. The chosen ids (at most per_class for each class) are broadcast to fetch the texts. Only for fitting models.
    """
    ids = docs.select(id_col, F.length(text_col).alias("_n")).filter(F.col("_n").between(1, max_chars)).select(id_col)
    share = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 11) / F.lit(2.0**53)
    known = classes.select(id_col, class_col).filter(F.col(class_col).isNotNull()).join(ids, id_col, "left_semi").withColumn("_share", share)
    bound = (per_class + 6 * per_class**0.5 + 40) / F.count("*")
    bounds = F.broadcast(known.groupBy(class_col).agg(bound.alias("_bound")))  # one row a class
    order = Window.partitionBy(class_col).orderBy("_share", id_col)
    chosen = (
        known.join(bounds, class_col).filter(F.col("_share") <= F.col("_bound"))
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class).select(id_col, class_col)
    )
    return docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("_id"), "_text", F.col(class_col).alias("_class"))
