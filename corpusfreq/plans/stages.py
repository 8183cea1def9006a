"""The stages clean, unique, frequencies and tokenize over tables of documents, each written for the next, and their command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.functions import addresses, python_text
from corpusfreq.functions import text as T
from corpusfreq.operators import cues, dedup, frequency, sampling
from corpusfreq.plans import tokenizers
from corpusfreq.sources import files


@dataclass
class Options:
    """What the stages do; the command line has a flag for each."""

    lang: str = "en"
    steps: list[str] = field(default_factory=lambda: ["clean", "unique", "frequencies"])
    tokenization: str | None = "regex"
    unique_tokenization: str | None = None
    pos: bool = False
    form: str = "surface"
    force_split: int | None = None
    smart_apostrophe: bool = True
    filter_tokens: bool = True
    filter_descriptions: bool = True
    ngrams: tuple[int, int] = (1, 1)
    limit_categories: list[str] = field(default_factory=list)
    start: int | None = None
    stop: int | None = None
    categories: bool = True
    min_videos: int = 0
    min_channels: int = 0
    tokenized: str | None = None
    transcripts: str | None = None
    norms: bool = False

    def __post_init__(self) -> None:
        if {"frequencies", "tokenize"} <= set(self.steps):
            raise ValueError("frequencies and tokenize exclude each other")
        if unknown := set(self.steps) - {"clean", "unique", "frequencies", "tokenize"}:
            raise ValueError(f"unknown stages {sorted(unknown)}")


def clean(subtitles: DataFrame, lang: str, own_line: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((video_id, text), funnel) of subtitle files (video_id, vtt). own_line classifies a column `line`; without it the language filter lets all pass."""
    parsed = cues.parse_cues(subtitles).withColumn("text", T.markup_to_text(F.col("raw")))
    kinds = cues.clean_cues(parsed)
    counters = cues.cue_stats(kinds)
    lines = cues.lines_of(kinds, "video_id", ["idx"])
    stats = cues.clean_lines(lines, "video_id", lang)
    kept = lines.withColumn("line", T.normalize_space(T.strip_invalid_tags(F.col("line"))))
    kept = kept.filter((F.col("line") == "") | (T.chars_in(F.col("line"), lang) > 0) & ~F.col("line").isin(" "))
    marked = subtitles.select("video_id").join(stats, "video_id", "left").join(counters, "video_id", "left").na.fill(0)
    if own_line is not None:
        marked = marked.join(cues.lang_ratio(kept, "video_id", own_line), "video_id", "left").na.fill(0.0, ["lang_ratio"])
    ratio = F.col("lang_ratio") if own_line is not None else F.lit(1.0)
    marked = marked.withColumn("reason", cues.reason(F.col("n_text"), F.col("charset_ratio"), ratio))
    text = kept.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    valid = text.join(marked.filter("reason = 'valid'").select("video_id"), "video_id", "left_semi")
    return valid.withColumn("text", F.concat("text", F.lit("\n"))), cues.funnel(marked, ["n_tags", "n_blank", "n_nonl", "n_lines", "n_cues", "n_empty", "n_repeat", "n_scroll", "n_delay"])


def unique(docs: DataFrame, lang: str, id_col: str = "video_id", ngrams: tuple[int, int] = (1, 1), threshold: float = dedup.THRESHOLD, tokenization: str | None = None) -> DataFrame:
    """Documents without those that resemble an earlier one."""
    toks = F.transform(tokenizers.tokenizer(tokenization or tokenizers.dedup_choice(lang))(F.col("text")), F.lower)
    found = dedup.search(docs, id_col, dedup.ngrams(toks, *ngrams), threshold)
    return dedup.survivors(docs, dedup.removed(found), id_col)


def _word_tokens(tokenize: tokenizers.Tokenizer, filter_tokens: bool) -> tokenizers.Tokenizer:
    return (lambda c: F.filter(T.replace_numbers(tokenize(c)), lambda t: T.is_word(t) | (t == T.NUM))) if filter_tokens else tokenize


def frequencies(docs: DataFrame, listed: DataFrame | None, lang: str, tokenization: str | None = "regex", id_col: str = "video_id", channel_col: str = "channel_id", category_col: str | None = None,
                categories: list[str] = (), min_videos: int = 0, min_channels: int = 0, filter_tokens: bool = False, replace: bool = True, norms: bool = False, tokens: Column | None = None,
                keep: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, total row, replaced addresses). Channels and categories come from the list; videos that it lacks are an error. Without a list there are no channels.

    tokens: tokens made already; keep: what holds for a word that counts; norms: all normal forms, with norm.
    """
    text = T.tilde_map(F.col("text"))
    if tokens is None:
        only = _word_tokens(tokenizers.tokenizer(tokenizers.choose(lang, tokenization)), filter_tokens)
        tokens = addresses.tokens_with_addresses(text, only) if replace else only(text)
    if keep is not None:
        tokens = F.filter(tokens, lambda t: keep(t))
    joined = docs
    if listed is not None:
        columns = [c for c in (channel_col, category_col) if c]
        joined = docs.join(listed.select(id_col, *columns, F.lit(True).alias("_listed")), id_col, "left")
        joined = joined.filter(F.assert_true(F.col("_listed").isNotNull(), F.concat(F.lit("not in the list: "), F.col(id_col).cast("string"))).isNull())
    grain = frequency.words(joined, id_col, tokens, channel_col if listed is not None else None, category_col if listed is not None else None)
    counts = frequency.norm_counts(grain, list(categories)) if norms else frequency.word_counts(grain, list(categories))
    words = frequency.at_least(counts, min_videos, min_channels if listed is not None else 0)
    total = frequency.totals(grain, listed if listed is not None else docs.withColumn(channel_col, F.lit(None).cast("string")), id_col, channel_col, list(categories))
    hits = docs.select(F.col(id_col).alias("doc"), F.posexplode(addresses.found(text)).alias("pos", "address")).withColumn("name", addresses.kind(F.col("address")))
    return words, total, frequency.address_log(hits)


def tokenize(docs: DataFrame, lang: str, tokenization: str | None = "regex", id_col: str = "video_id", replace: bool = True, abbreviations: list[str] = (), force_split: int | None = None) -> DataFrame:
    """(id, n, line): a line of tokens a sentence, normalised (NFKC, lower case), with what stands for addresses in their places."""
    base = tokenizers.tokenizer(tokenizers.choose(lang, tokenization))
    text = T.newline_conversion(T.tilde_map(F.col("text")))
    if force_split:
        text = python_text.force_split(text, force_split)
    rows = docs.select(F.col(id_col), F.posexplode(python_text.sentences(text, lang, abbreviations)).alias("n", "sentence"))
    toks = addresses.tokens_with_addresses(F.col("sentence"), base) if replace else base(F.col("sentence"))
    lines = rows.select(id_col, "n", F.array_join(toks, " ").alias("line")).filter("line <> ''")
    return lines.select(id_col, "n", python_text.nfkc_lower(F.col("line")).alias("line"))


def run(spark: SparkSession, subtitles: str, listed: str | None, lang: str, out: str, options: Options | None = None, own_line: Column | None = None) -> None:
    """The chosen stages, from files to tables below out; a stage that isn't chosen is taken from the table of an earlier run."""
    o = options or Options(lang=lang, filter_tokens=False)
    videos = files.read_list(spark, listed) if listed else None
    if videos is not None and o.limit_categories:
        videos = files.in_categories(videos, o.limit_categories)
    if videos is not None and (o.start is not None or o.stop is not None):
        videos = sampling.ordered_slice(videos, "video_id", o.start, o.stop)
    if "clean" in o.steps and o.tokenized is None and o.transcripts is None:
        vtt = files.read_vtt(spark, subtitles)
        vtt = vtt.join(videos.select("video_id"), "video_id", "left_semi") if videos is not None else vtt
        texts, funnel = clean(vtt, lang, own_line)
        texts.write.parquet(f"{out}/clean")
        funnel.write.parquet(f"{out}/funnel")
    if "unique" in o.steps and o.tokenized is None and o.transcripts is None:
        unique(spark.read.parquet(f"{out}/clean"), lang, ngrams=o.ngrams, tokenization=o.unique_tokenization).write.parquet(f"{out}/unique")
    if not {"frequencies", "tokenize"} & set(o.steps):
        return
    made = None
    if o.tokenized:
        docs, made = files.read_files(spark, o.tokenized, "", id_col="video_id"), files.tokenized
    elif o.transcripts:
        docs = files.read_conversations(spark, o.transcripts).withColumnRenamed("doc_id", "video_id")
    else:
        docs = spark.read.parquet(f"{out}/unique")
    if o.smart_apostrophe and lang == "en" and made is None:
        docs = docs.withColumn("text", python_text.smart_apostrophe(F.col("text")))
    if "tokenize" in o.steps:
        lines = tokenize(docs, lang, o.tokenization, replace=made is None, force_split=o.force_split)
        files.write_sentences(lines.repartitionByRange("video_id", "n").sortWithinPartitions("video_id", "n"), f"{out}/tokenized")
        return
    names = sorted(r["category"] for r in videos.select("category").distinct().collect() if r["category"]) if videos is not None and o.categories else []  # a fixed set of the platform
    keep = None if o.filter_descriptions else (lambda t: ~t.rlike(r"^\[.*\]$"))
    words, total, log = frequencies(
        docs, videos, lang, o.tokenization, category_col="category" if names else None, categories=names, min_videos=o.min_videos, min_channels=o.min_channels, filter_tokens=o.filter_tokens,
        replace=made is None, norms=o.norms, tokens=made(docs) if made else None, keep=keep)
    (files.write_norms if o.norms else files.write_frequencies)(words, total, f"{out}/frequencies{'-%' if o.norms else ''}")
    if videos is not None:
        files.write_histogram(frequency.channel_histogram(videos, "channel_id"), f"{out}/channels")
    files.write_addresses(log, f"{out}/addresses")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Stages of a corpus of subtitles or transcripts; without a stage all but tokenize.")
    p.add_argument("--data", required=True, help="folder of subtitle files")
    p.add_argument("--list", help="list of videos")
    p.add_argument("--output", required=True, help="folder of the tables")
    p.add_argument("--lang", default="en")
    for step in ("clean", "unique", "frequencies", "tokenize"):
        p.add_argument(f"--{step}", dest="steps", action="append_const", const=step)
    p.add_argument("--tokenization", default="regex", help="regex, treebank or a registered model")
    p.add_argument("--unique-tokenization", help="the same for unique")
    p.add_argument("--form", default="surface", choices=("surface", "base", "lemma"))
    p.add_argument("--pos", action="store_true", help="parts of speech, by a registered tagger")
    p.add_argument("--force-split", type=int, help="split spans without a sentence end that are longer")
    p.add_argument("--ngram-min", type=int, default=1)
    p.add_argument("--ngram-max", type=int, default=1)
    p.add_argument("--limit-categories", nargs="+", default=[])
    p.add_argument("--start", type=int)
    p.add_argument("--stop", type=int)
    p.add_argument("--min-videos", type=int, default=0)
    p.add_argument("--min-channels", type=int, default=0)
    p.add_argument("--tokenized", help="files of tokens in place of the unique table")
    p.add_argument("--transcripts", help="transcripts of conversations in place of it")
    p.add_argument("--norms", action="store_true", help="a table for each normal form")
    for flag, name in (("--no-filter-tokens", "filter_tokens"), ("--no-categories", "categories"), ("--no-smart-apostrophe", "smart_apostrophe"), ("--no-descriptions", "filter_descriptions")):
        p.add_argument(flag, dest=name, action="store_false")
    return p


def options(args: argparse.Namespace) -> Options:
    given = {k: v for k, v in vars(args).items() if k not in ("data", "list", "output", "ngram_min", "ngram_max", "steps")}
    o = Options(**given, ngrams=(args.ngram_min, args.ngram_max), steps=args.steps or ["clean", "unique", "frequencies"])
    name = tokenizers.choose(o.lang, o.tokenization, o.form, o.pos)
    if o.tokenized is None:
        tokenizers.tokenizer(name)  # fails early if it isn't there
    return o


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    run(SparkSession.builder.getOrCreate(), a.data, a.list, a.lang, a.output, options(a))


if __name__ == "__main__":
    main()
