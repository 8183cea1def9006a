"""Word frequencies: tokens, documents and channels a word, categories, parts of speech, normal forms and totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions import python_text
from corpusfreq.session import pieces

TOTAL = "[TOTAL]"
MARKUP = ["align", "br", "colspan", "https", "lt", "onlyinclude", "ref", "ruby"]
MARKUP_TOP = 6000
NORMS = ["none", "lower", "nfkc", "nfkc-lower"]


def words(docs: DataFrame, id_col: str, tokens: Column, channel_col: str | None = None, category_col: str | None = None, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, channel, category, word, n): tokens of each document; the grain of all counts. An empty or null channel is one of its own for each document.

    The texts are partitioned by document, which is less than their tokens; grouping by document and word then stays in place. form: what is made of each token.
    """
    made = form or (lambda t: t)
    name = F.coalesce(F.concat(F.lit("c:"), F.nullif(F.col(channel_col), F.lit(""))), F.concat(F.lit("d:"), F.col(id_col).cast("string"))) if channel_col else F.lit(None).cast("string")
    category = F.col(category_col) if category_col else F.lit(None).cast("string")
    placed = docs.repartition(pieces(docs), id_col).select(F.col(id_col).alias("doc"), name.alias("channel"), category.alias("category"), F.explode(tokens).alias("word"))
    return placed.withColumn("word", made(F.col("word"))).groupBy("doc", "channel", "category", "word").agg(F.count("*").alias("n"))


def word_counts(grain: DataFrame, categories: list[str] = (), by: list[str] = ()) -> DataFrame:
    """(by..., word, count, videos, channels, count:<category>...). Channels are counted over distinct (word, channel) rows, in two steps
    of partial aggregation, so frequent words don't gather sets."""
    keys = [*by, "word"]
    per = grain.groupBy(*keys, "channel").agg(F.sum("n").alias("n"), F.count("*").alias("v"), *(F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(f"_c{k}") for k, c in enumerate(categories)))
    return per.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("v").alias("videos"), F.count("channel").alias("channels"), *(F.sum(f"_c{k}").alias(f"count:{c}") for k, c in enumerate(categories)))


def norm_counts(grain: DataFrame, categories: list[str] = (), forms: list[str] = NORMS) -> DataFrame:
    """word_counts of every normal form, with norm. A word goes on once a different form, with a bit for each norm that it is the form of, and all norms are counted side by side:
    words that meet in a form have their documents and channels merged where the texts were partitioned by document, and each form is shuffled once with its channel."""
    low, nfkc = F.lower("word"), F.col("_k")
    made = {"none": F.col("word"), "lower": low, "nfkc": nfkc, "nfkc-lower": F.lower(nfkc)}
    known = [made[f] for f in forms]
    bits = lambda k: sum((F.when(known[j] == known[k], 1 << j).otherwise(0) for j in range(k + 1, len(forms))), F.lit(1 << k))
    new = lambda k: reduce(lambda a, b: a & b, (known[j] != known[k] for j in range(k)), F.lit(True))
    each = F.array(*(F.when(new(k), F.struct(known[k].alias("form"), bits(k).alias("bits"))) for k in range(len(forms))))
    same = reduce(lambda a, b: a & b, (c == known[0] for c in known[1:]), F.lit(True))
    rows = grain.withColumn("_k", python_text.nfkc(F.col("word"))).select("doc", "channel", "category", "n", F.explode(F.when(same, F.array(F.struct(known[0].alias("form"), F.lit((1 << len(forms)) - 1).alias("bits")))).otherwise(F.array_compact(each))).alias("x"))
    rows = rows.select("doc", "channel", "category", F.col("x.form").alias("word"), *(F.when(F.col("x.bits").bitwiseAND(1 << k) != 0, F.col("n")).alias(f"n{k}") for k in range(len(forms))))
    merged = rows.groupBy("doc", "channel", "category", "word").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(forms))))
    of = lambda k: [F.sum(f"n{k}").alias(f"n{k}"), F.count(f"n{k}").alias(f"v{k}"), *(F.sum(F.when(F.col("category") == c, F.col(f"n{k}"))).alias(f"c{k}_{i}") for i, c in enumerate(categories))]
    per = merged.groupBy("word", "channel").agg(*(c for k in range(len(forms)) for c in of(k)))
    total = lambda k: [F.sum(f"n{k}").alias(f"n{k}"), F.sum(f"v{k}").alias(f"v{k}"), F.count(F.when(F.col(f"v{k}") > 0, F.col("channel"))).alias(f"h{k}"), *(F.sum(f"c{k}_{i}").alias(f"c{k}_{i}") for i in range(len(categories)))]
    wide = per.groupBy("word").agg(*(c for k in range(len(forms)) for c in total(k)))
    row = lambda k: F.struct(F.lit(forms[k]).alias("norm"), F.col(f"n{k}").alias("count"), F.col(f"v{k}").alias("videos"), F.col(f"h{k}").alias("channels"),
                             *(F.coalesce(f"c{k}_{i}", F.lit(0)).alias(f"count:{c}") for i, c in enumerate(categories)))
    out = wide.select("word", F.explode(F.array(*(row(k) for k in range(len(forms))))).alias("x")).filter("x.count IS NOT NULL")
    return out.select("word", "x.count", "x.videos", "x.channels", *(F.col("x").getField(f"count:{c}").alias(f"count:{c}") for c in categories), "x.norm")


def at_least(counts: DataFrame, videos: int = 0, channels: int = 0, compat: bool = False) -> DataFrame:
    """Rows with so many documents and channels. compat: the channel bound is held against documents."""
    return counts.filter((F.col("videos") >= videos) & (F.col("videos" if compat else "channels") >= channels))


def totals(grain: DataFrame, listed: DataFrame, id_col: str, channel_col: str, categories: list[str] = ()) -> DataFrame:
    """One row: all tokens before any filter, documents, and the channels of the list, which may hold more documents than survived."""
    own = grain.groupBy("doc").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("category") == c, F.col("n"))).alias(f"_c{k}") for k, c in enumerate(categories)))
    tokens = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), *(F.coalesce(F.sum(f"_c{k}"), F.lit(0)).alias(f"count:{c}") for k, c in enumerate(categories)), F.count("*").alias("videos"))
    return tokens.crossJoin(channel_count(listed, channel_col)).withColumn("word", F.lit(TOTAL))


def channel_count(listed: DataFrame, channel_col: str) -> DataFrame:
    """One row: distinct named channels and, each on its own, documents without one."""
    c = F.nullif(F.col(channel_col), F.lit(""))
    return listed.agg((F.countDistinct(c) + F.count_if(c.isNull())).alias("channels"))


def channel_histogram(listed: DataFrame, channel_col: str) -> DataFrame:
    """(videos_in_channel, channels), the documents without channel under NO_CHANNEL_ID."""
    c = F.nullif(F.col(channel_col).cast("string"), F.lit(""))
    sizes = listed.filter(c.isNotNull()).groupBy(c.alias("c")).agg(F.count("*").alias("n"))
    histogram = sizes.groupBy(F.col("n").cast("string").alias("videos_in_channel")).agg(F.count("*").alias("channels"))
    return histogram.unionByName(listed.agg(F.count_if(c.isNull()).alias("channels")).select(F.lit("NO_CHANNEL_ID").alias("videos_in_channel"), "channels"))


def dominant_pos(tagged: DataFrame) -> DataFrame:
    """(word, pos): the commonest part of speech; ties go to the first by name, missing ones count as N/A."""
    counts = tagged.groupBy("word", F.coalesce("pos", F.lit("N/A")).alias("pos")).agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(F.min_by("pos", F.struct((-F.col("n")).alias("n"), "pos")).alias("pos"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; ties by word."""
    return counts.orderBy(F.desc("count"), "word").limit(k)


def markup_warnings(counts: DataFrame, top: int = MARKUP_TOP) -> DataFrame:
    """Mark-up names among the most frequent words."""
    return top_words(counts, top).filter(F.col("word").isin(MARKUP)).select("word", "count")


def merge_grains(*parts: DataFrame) -> DataFrame:
    """One grain of several corpora; parts of speech and categories can't be merged."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc", "channel", "category", "word").agg(F.sum("n").alias("n"))


def counter_difference(all_: DataFrame, part: DataFrame) -> DataFrame:
    """(word, count) of all_ less part, words at 0 left out; fails if a count would be negative."""
    both = all_.select("word", F.col("count").alias("a")).join(part.select("word", F.col("count").alias("b")), "word", "full_outer")
    d = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return both.withColumn("count", F.when(F.assert_true(d >= 0, F.concat(F.lit("negative count of "), F.col("word"))).isNull(), d)).filter("count > 0").select("word", "count")


def address_log(found: DataFrame) -> DataFrame:
    """(name, doc, pos, address): removed addresses as rows, to be ordered by these columns. found: (doc, pos, name, address)."""
    return found.select("name", "doc", "pos", "address")
