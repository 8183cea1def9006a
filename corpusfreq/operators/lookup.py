"""Look-up of target words in frequency lists, with smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.session import materialize


def size(freq: DataFrame) -> DataFrame:
    """One row: tokens and types of a list of (word, count)."""
    return freq.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))


def smoothed(words: DataFrame, freq: DataFrame, word_col: str = "word", totals: DataFrame | None = None) -> DataFrame:
    """words with freq = (count + 1) / (tokens + types) and missing (count 0). totals: one row (tokens, types), else counted from the list."""
    found = words.join(freq.select(F.col("word").alias("_w"), F.col("count").alias("_n")), F.col(word_col) == F.col("_w"), "left")
    n = F.coalesce("_n", F.lit(0))
    one = F.broadcast((totals if totals is not None else size(freq)).select(F.col("tokens").alias("_t"), F.col("types").alias("_k")))  # one row
    return found.crossJoin(one).withColumn("freq", (n + 1) / (F.col("_t") + F.col("_k"))).withColumn("missing", n == 0).drop("_w", "_n", "_t", "_k")


#: Words whose frequencies go to all tasks.
FREQUENT = 1 << 16


def mean_log(tokens: DataFrame, freq: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x, nt): mean log10 of the smoothed frequencies of each group's words, and their number. tokens: (by..., word), a row each.

    The most frequent words are summed where they stand; only the others, a small part of the text, are joined.
    """
    one = size(freq).first()
    log = lambda n: F.log10((n + 1) / F.lit(one["tokens"] + one["types"]))
    top = F.broadcast(freq.orderBy(F.desc("count"), "word").limit(FREQUENT).select("word", log(F.col("count")).alias("_f")))  # bounded
    sums = tokens.join(top, "word", "left").select(*by, F.when(F.col("_f").isNull(), F.col("word")).alias("_rest"), "_f").groupBy(*by, "_rest").agg(F.sum("_f").alias("_f"), F.count("*").alias("_k"))
    sums, _ = materialize(sums, "tokens")
    rest = sums.filter("_rest IS NOT NULL").join(freq.select(F.col("word").alias("_rest"), "count"), "_rest", "left")
    both = sums.filter("_rest IS NULL").select(*by, "_f", "_k").unionByName(rest.select(*by, (log(F.coalesce("count", F.lit(0))) * F.col("_k")).alias("_f"), "_k"))
    return both.groupBy(*by).agg((F.sum("_f") / F.sum("_k")).alias("x"), F.sum("_k").alias("nt"))


def unsmoothed(words: DataFrame, values: DataFrame, word_col: str = "word", worst: str = "min", divide: float = 1.0) -> DataFrame:
    """words with freq from (word, value); missing words get the list's least (or, with worst='max', largest) value."""
    extreme = F.broadcast(values.agg((F.max if worst == "max" else F.min)("value").alias("_x")))  # one row
    found = words.join(values.select(F.col("word").alias("_w"), F.col("value").alias("_v")), F.col(word_col) == F.col("_w"), "left").crossJoin(extreme)
    return found.withColumn("missing", F.col("_v").isNull()).withColumn("freq", F.coalesce("_v", "_x") / F.lit(divide)).drop("_w", "_v", "_x")


def targets(gold: DataFrame, id_col: str, text_col: str, tokens: Column, look, higher_is_worse: bool = False) -> DataFrame:
    """(id, freq, missing) of targets of several tokens: the worst frequency of the tokens, missing if any is; the whole string instead where it does better.

    look: (DataFrame, word_col) -> the same with freq and missing. Without tokens the frequency is 0, or infinity where higher is worse.
    """
    rows = gold.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_whole"), tokens.alias("_tokens"))
    each = look(rows.select("_id", F.explode("_tokens").alias("_word")), "_word")
    worst = each.groupBy("_id").agg((F.max if higher_is_worse else F.min)("freq").alias("_f"), F.bool_or("missing").alias("_m"))
    whole = look(rows.select("_id", "_whole"), "_whole")
    f = F.coalesce("_f", F.lit(float("inf") if higher_is_worse else 0.0))
    better = (F.col("freq") < f) if higher_is_worse else (F.col("freq") > f)
    return whole.join(worst, "_id", "left").select(
        F.col("_id").alias(id_col), F.when(better, F.col("freq")).otherwise(f).alias("freq"), F.when(better, F.col("missing")).otherwise(F.coalesce("_m", F.lit(False))).alias("missing"))


def prefer(*sources: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the last source that has the key; sources with equal columns."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(k))
        out = s if out is None else out.unionByName(s)
    others = [c for c in out.columns if c not in (*keys, "_rank")]
    return out.groupBy(*keys).agg(*(F.max_by(c, "_rank").alias(c) for c in others))
