"""Readers and writers of subtitle folders, document stores, lists, frequency tables and logs."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.functions import text as T
from corpusfreq.operators import frequency, sampling
from corpusfreq.session import materialize

#: Category numbers of the list file's source and their names.
CATEGORIES = {1: "Film & Animation", 2: "Autos & Vehicles", 10: "Music", 15: "Pets & Animals", 17: "Sports", 19: "Travel & Events", 20: "Gaming", 22: "People & Blogs",
              23: "Comedy", 24: "Entertainment", 25: "News & Politics", 26: "Howto & Style", 27: "Education", 28: "Science & Technology", 29: "Nonprofits & Activism"}


def unpack(name: str, data: bytes, encoding: str = "utf-8", member: str | None = None) -> str:
    """Text of a plain, .gz, .bz2, .xz or .zip file by its suffix; a zip holds one member, or `member` names it."""
    if name.endswith(".xz"):
        data = lzma.decompress(data)
    elif name.endswith(".gz"):
        data = gzip.decompress(data)
    elif name.endswith(".bz2"):
        data = bz2.decompress(data)
    elif name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = [n for n in z.namelist() if not n.endswith("/")]
            if member is None and len(inside) != 1:
                raise ValueError(f"{name}: name one of its members {inside[:5]}")
            data = z.read(member or inside[0])
    return data.decode(encoding)


def read_files(spark: SparkSession, path: str, suffix: str, encoding: str = "utf-8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of all files below path with the suffix, id being the file's stem. Built-in text reading for UTF-8, Python for other encodings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    stem = F.regexp_extract(F.regexp_replace("path", r"^.*/", ""), rf"^(.*){suffix.replace('.', '[.]')}$", 1)
    if encoding.lower().replace("-", "") == "utf8":
        return files.select(stem.alias(id_col), F.decode("content", "UTF-8").alias(text_col))

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(encoding))

    return files.select(stem.alias(id_col), decoded("content").alias(text_col))


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, ".vtt", id_col="video_id", text_col="vtt")


def read_zip(spark: SparkSession, path: str, suffix: str = ".txt", encoding: str = "utf-8") -> DataFrame:
    """(doc_id, text) of the members of zip files with the suffix, one archive a task at a time, one member in memory."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if n.endswith(suffix):
                            yield pd.DataFrame({"doc_id": [n.rpartition("/")[2][: -len(suffix)]], "text": [z.read(n).decode(encoding)]})

    return archives.mapInPandas(run, "doc_id string, text string")


def read_store(spark: SparkSession, path: str, suffix: str = ".txt", encoding: str = "utf-8", names: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of a document store: a Parquet table, zip archives or a folder of files. names: the files that are meant (with their suffix); an error if one is missing."""
    if path.endswith(".zip"):
        docs = read_zip(spark, path, suffix, encoding).withColumnsRenamed({"doc_id": id_col, "text": text_col})
    elif path.endswith(".parquet"):
        docs = spark.read.parquet(path).select(id_col, text_col)
    else:
        docs = read_files(spark, path, suffix, encoding, id_col, text_col)
    if names is None:
        return docs
    stems = [n.removesuffix(suffix) for n in names]
    if gone := set(stems) - {r[0] for r in docs.select(id_col).filter(F.col(id_col).isin(stems)).collect()}:
        raise FileNotFoundError(sorted(gone))
    return docs.filter(F.col(id_col).isin(stems))


def in_registry_order(rows: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Rows ordered by the place of their corpus in the registry (unknown ones last, by name), for tables of a row a corpus."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(names) + 1), column)


def write_store(docs: DataFrame, path: str, mode: str = "error") -> None:
    docs.write.mode(mode).parquet(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Video list: manual subtitles only, first of repeated ids, unknown channels as ''. channelid and channel_id are the same column."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    for old, new in (("videoid", "video_id"), ("channelid", "channel_id"), ("categories", "category")):
        if old in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    for c in ("channel_id", "category", "duration", "auto"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    typed = rows.select("video_id", F.lower("sub").isin("true", "1", "yes").alias("sub"), F.lower("auto").isin("true", "1", "yes").alias("auto"), F.coalesce("channel_id", F.lit("")).alias("channel_id"),
                        F.coalesce("category", F.lit("")).alias("category"), F.col("duration").try_cast("double").alias("duration"), "_at")
    return sampling.first_by(typed.filter("sub"), "video_id", "_at").drop("_at")


def in_categories(listed: DataFrame, wanted: list[int | str]) -> DataFrame:
    """Restrict a list to categories given by number or name."""
    names = [CATEGORIES.get(w, w) if isinstance(w, int) else w for w in wanted]
    if unknown := [n for n in names if n not in CATEGORIES.values()]:
        raise ValueError(f"unknown categories {unknown}")
    return listed.filter(F.col("category").isin(names))


def tokenized(docs: DataFrame, text_col: str = "text") -> Column:
    """Tokens of pre-tokenised text, numbers replaced and filtered to words."""
    return F.filter(T.replace_numbers(T.split_words(F.col(text_col))), lambda t: T.is_word(t) | (t == T.NUM))


def read_labotv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, tokens, line_no) of `id,TOKEN+POS TOKEN+POS` files; two files make one document."""
    parts = None
    for k, p in enumerate(paths):
        lines = spark.read.text(p).select(F.lit(k // 2).alias("doc_id"), F.monotonically_increasing_id().alias("line_no"), F.split(F.regexp_replace("value", r"^[^,]*,", ""), rf"\+[{T.WORD}]+\s*").alias("t"))
        lines = lines.select("doc_id", "line_no", F.when(F.assert_true(F.element_at("t", -1) == "", F.lit("token without part of speech")).isNull(), F.slice("t", 1, F.size("t") - 1)).alias("tokens"))
        parts = lines if parts is None else parts.unionByName(lines)
    return parts


def conversation_text(text: Column) -> Column:
    """Transcript lines without comments, blank lines, time stamps, speakers, noise marks and filler marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9.]+ [0-9.]+ [A-Z]+: |\{[^{]+\}|<[^<]+>|%", "")), "\n")


def read_conversations(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    return read_files(spark, path, suffix, encoding="gbk").withColumn("text", conversation_text(F.col("text")))


def frequency_lines(spark: SparkSession, path: str, encoding: str = "utf-8", member: str | None = None) -> DataFrame:
    """(n, line) of a frequency list of any codec. Plain, gzip and bzip2 lists are read by Spark; xz and zip go through Python, a file each."""
    if not path.endswith((".xz", ".zip")) and encoding.lower().replace("-", "") == "utf8":
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                lines = unpack(path, content, encoding, member).split("\n")
                for a in range(0, len(lines), 50_000):
                    yield pd.DataFrame({"n": range(a, a + len(lines[a : a + 50_000])), "line": lines[a : a + 50_000]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, line string")


def read_frequencies(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool | list[str] = True, delimiter: str = "\t", total_row: str | None = None, total_header: bool = False,
                     sub_lemma: str | None = None, to_lower: bool = False, ignore_errors: bool = False, encoding: str = "utf-8", member: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((word, count, cd), one row (tokens, types)) of a frequency list.

    Comment lines (#) stand before the header. columns picks word, count and context diversity by name; sub_lemma is joined by a hyphen where it isn't empty. Counts of
    equal words are summed, diversity is their largest. Totals come from a row, from two header lines, or from the sum.
    """
    lines = frequency_lines(spark, path, encoding, member).filter(F.length(F.rtrim("line", F.lit(delimiter + "\n"))) > 0)
    told = None
    if total_header:
        told = lines.filter(F.col("line").rlike(r"^(Total word count|Context number):"))
        tokens = told.select(F.max(F.when(F.col("line").startswith("Total"), F.regexp_replace("line", r"[^0-9]", "").cast("long"))).alias("tokens"))
        lines = lines.filter(~F.col("line").rlike(r"^(Total word count|Context number):"))
    names = header if isinstance(header, list) else None
    if header is True:
        lines = lines.filter(~F.col("line").startswith("#"))
        first = lines.orderBy("n").first()
        names = first["line"].rstrip("\n").split(delimiter)
        lines = lines.filter(F.col("n") != first["n"])
    pick = [names.index(c) for c in columns] if columns else list(range(min(3, len(names) if names else 2)))
    fields = F.split("line", "\\Q" + delimiter + "\\E")
    word = F.get(fields, F.lit(pick[0]))
    if sub_lemma:
        sub = F.get(fields, F.lit(names.index(sub_lemma)))
        word = F.when(F.coalesce(sub, F.lit("")) != "", F.concat(word, F.lit("-"), sub)).otherwise(word)
    number = (lambda k: F.get(fields, F.lit(pick[k])).try_cast("long")) if ignore_errors else (lambda k: F.get(fields, F.lit(pick[k])).cast("long"))
    rows = lines.select((F.lower(word) if to_lower else word).alias("word"), number(1).alias("count"), (number(2) if len(pick) > 2 else F.lit(None).cast("long")).alias("cd"))
    rows = (rows.filter("count IS NOT NULL") if ignore_errors else rows).groupBy("word").agg(F.sum("count").alias("count"), F.max("cd").alias("cd"))
    words = rows.filter(F.col("word") != total_row) if total_row else rows
    types = words.agg(F.count("*").alias("types"))
    if total_row:
        return words, rows.filter(F.col("word") == total_row).agg(F.max("count").alias("tokens")).crossJoin(types)
    return words, (tokens if told is not None else words.agg(F.sum("count").alias("tokens"))).crossJoin(types)


#: Ratings and reaction times by name: language, and how read_gold takes the file apart.
GOLD = {
    "ldt-en": ("en", dict(word="Word", score="I_Mean_RT", lower_only=True, null="#")), "ldt-en-z": ("en", dict(word="Word", score="I_Zscore", lower_only=True, null="#")),
    "ldt-es": ("es", dict(word="word", score="rt")), "ldt-zh": ("zh", dict(word="word", score="RT", where="lexicality = 1")), "ldt-zh-z": ("zh", dict(word="word", score="zRT", where="lexicality = 1")),
    "familiarity-zh": ("zh", dict(word="WORD", score="FAM_M", delimiter="\t")), "familiarity-id": ("id", dict(word="Words (Indonesian)", score="ALL_Frequency_Mean")),
    "familiarity-en": ("en", dict(word="WORD", score="FAM")), "familiarity-en-glasgow": ("en", dict(word="Words", score="FAM", drop_senses=True, skip=1)),
    "familiarity-en-paivio": ("en", dict(word="WORD", score="FAM", delimiter=" ", to_lower=True)),
    "familiarity-es": ("es", dict(word="Word", score="FAM_M", strip=True)), "familiarity-es-moreno": ("es", dict(word="Spanish", score="Fam", strip=True)),
    "familiarity-ja-amano": ("ja", dict(word="表記", score="文字単語親密度", at_least=0.0)),
    **{f"familiarity-ja-{k}": ("ja", dict(word="見出し本体", score=c)) for k, c in {
        "know": "知っている", "read": "読む", "speak": "話す", "listen": "聞く", "production": "生産", "reception": "受容", "writing": "書記", "speech": "音声",
        "production-reception": "生産-受容", "writing-speech": "書記-音声"}.items()},
}


def read_gold_named(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(word, gold) of a data set of GOLD, from the user's copy of its file."""
    if name not in GOLD:
        raise ValueError(f"unknown ratings {name}; known are {sorted(GOLD)}")
    return read_gold(spark, path, **GOLD[name][1])


def read_complexity(spark: SparkSession, path: str, delimiter: str = "\t", id_col: str = "id", context: str = "context", target: str = "target", score: str = "complexity") -> DataFrame:
    """(id, context, target, gold) of a shared-task set of words rated in context; targets may hold several tokens."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("quote", "").csv(path)
    return raw.select(F.col(id_col).alias("id"), F.col(context).alias("context"), F.col(target).alias("target"), F.col(score).try_cast("double").alias("gold")).filter("target IS NOT NULL AND gold IS NOT NULL")


def read_gold(spark: SparkSession, path: str, word: str, score: str, delimiter: str = ",", lower_only: bool = False, strip: bool = False, drop_senses: bool = False, at_least: float | None = None,
              where: str | None = None, null: str | None = None, to_lower: bool = False, skip: int = 0) -> DataFrame:
    """(word, gold): ratings averaged over repeated words; missing ones dropped, thousands commas allowed. where: SQL condition on the file's columns; null: what stands
    for a missing rating; skip: lines below the header that are no rows. A blank as delimiter stands for runs of white space. Files ending in .xz are read in one piece."""
    if delimiter == " " or path.endswith(".xz") or skip:
        raw = _split_table(frequency_lines(spark, path), delimiter, skip)
    else:
        raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    raw = raw.filter(where) if where else raw
    if null is not None:
        raw = raw.filter(F.coalesce(F.col(f"`{score}`"), F.lit(null)) != null)
    w = F.trim(F.col(f"`{word}`")) if strip else F.col(f"`{word}`")
    w = F.lower(w) if to_lower else w
    rows = raw.select(w.alias("word"), F.regexp_replace(F.col(f"`{score}`"), ",", "").try_cast("double").alias("gold")).filter("word IS NOT NULL AND gold IS NOT NULL")
    if lower_only:
        rows = rows.filter(F.lower("word") == F.col("word"))
    if drop_senses:
        rows = rows.filter(~F.contains("word", F.lit("(")))
    if at_least is not None:
        rows = rows.filter(F.col("gold") >= at_least)
    return rows.groupBy("word").agg(F.avg("gold").alias("gold"))


def _split_table(lines: DataFrame, delimiter: str, skip: int) -> DataFrame:
    """Columns named by the first of (n, line), without the `skip` lines after it. Fields aren't quoted, but for a comma as delimiter."""
    first = lines.orderBy("n").limit(1 + skip).collect()
    head, body = [r["line"] for r in first], lines.filter(~F.col("n").isin([r["n"] for r in first]))
    pattern = r"\s+" if delimiter == " " else r',(?=(?:[^"]*"[^"]*")*[^"]*$)' if delimiter == "," else "\\Q" + delimiter + "\\E"
    names = re.split(r"\s+", head[0].strip()) if delimiter == " " else [x.strip('"') for x in head[0].rstrip("\r\n").split(delimiter)]
    parts = F.split(F.trim("line") if delimiter == " " else F.rtrim(F.col("line"), F.lit("\r\n")), pattern)
    return body.filter(F.length(F.trim("line")) > 0).select(*(F.nullif(F.regexp_replace(F.get(parts, F.lit(k)), '^"|"$', ""), F.lit("")).alias(c) for k, c in enumerate(names) if c and c not in names[:k]))


def read_log(spark: SparkSession, path: str, patterns: dict[str, str], optional: tuple[str, ...] = ()) -> dict[str, int | None]:
    """First number that each pattern (one group) finds in a log's lines; an error for those missing but not optional."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value")
    hits = [F.min_by(F.when(F.col("value").rlike(p), F.regexp_replace(F.regexp_extract("value", p, 1), ",", "")), F.when(F.col("value").rlike(p), F.col("n"))).alias(k) for k, p in patterns.items()]
    row = lines.agg(*hits).first()
    if gone := [k for k in patterns if row[k] is None and k not in optional]:
        raise ValueError(f"{path} lacks {gone}")
    return {k: int(row[k]) if row[k] is not None else None for k in patterns}


def write_frequencies(counts: DataFrame, total: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated words by falling count (ties by word), then the total row."""
    rows = counts.withColumn("_last", F.lit(0)).unionByName(total.withColumn("_last", F.lit(1)), allowMissingColumns=True)
    order = rows.orderBy("_last", F.desc("count"), "word").drop("_last")
    if compression == "xz":
        return _write_xz(order, path)
    order.write.option("sep", "\t").option("header", True).option("compression", compression).option("quote", "").csv(path)


def _write_xz(rows: DataFrame, path: str) -> None:
    """Ordered rows as xz files, one a partition, with the header in the first. A file is written under a name of its attempt and then renamed, so lost attempts leave no part."""
    lines = rows.select(F.spark_partition_id().alias("part"), F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("line"))
    header = "\t".join(rows.columns) + "\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        out, box, part = None, lzma.LZMACompressor(), None
        for b in batches:
            for p, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    part, temp = p, f"{root}/_part-{p:05d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                    out.write(box.compress(header.encode()) if p == 0 else b"")
                out.write(box.compress((line + "\n").encode()))
        if out is not None:
            out.write(box.flush())
            out.close()
            fs.move(temp, f"{root}/part-{part:05d}.tsv.xz")
        yield pa.RecordBatch.from_arrays([pa.array([int(out is not None)], pa.int32())], ["files"])

    lines.mapInArrow(run, "files int").agg(F.sum("files")).collect()


def write_norms(counts: DataFrame, total: DataFrame, pattern: str, compression: str = "none") -> None:
    """A frequency list for each normal form of counts (with norm); % in the pattern stands for its name."""
    if "%" not in pattern:
        raise ValueError("the path has no %")
    counts, _ = materialize(counts, "norms")
    for norm in frequency.NORMS:
        write_frequencies(counts.filter(F.col("norm") == norm).drop("norm"), total, pattern.replace("%", norm), compression)


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", suffix: str = ".txt", archive: bool = False) -> None:
    """A file a document below path, named by its id; with archive, a zip a partition that holds them. Texts go in whole files renamed at their end."""
    narrow = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        n, mine, box, part = 0, uuid.uuid4().hex, None, None
        for b in batches:
            for p, key, text in zip(*(c.to_pylist() for c in b.columns)):
                n += 1
                if archive:
                    if box is None:
                        part, raw = p, fs.open_output_stream(f"{root}/_{mine}", compression=None)
                        box = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                    box.writestr(f"{key}{suffix}", text)
                else:
                    with fs.open_output_stream(f"{root}/_{mine}", compression=None) as out:
                        out.write(text.encode())
                    fs.move(f"{root}/_{mine}", f"{root}/{key}{suffix}")
        if box is not None:
            box.close()
            raw.close()
            fs.move(f"{root}/_{mine}", f"{root}/part-{part:05d}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    narrow.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_histogram(histogram: DataFrame, path: str) -> None:
    histogram.write.option("sep", "\t").option("header", True).csv(path)


def write_addresses(log: DataFrame, path: str) -> None:
    """One JSON object a line, an address with its kind, in order of kind, document and place."""
    rows = log.repartitionByRange("name", "doc", "pos").sortWithinPartitions("name", "doc", "pos")
    rows.select(F.to_json(F.struct("name", "address")).alias("value")).write.text(path)


def write_sentences(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.text(path)


def save_model(model: DataFrame, path: str) -> None:
    model.write.parquet(path)


#: Public corpora that frequency norms are held against, with their languages; the last four are the user's own lists.
CORPORA = [(n, x) for n, langs in {
    "BNC-Spoken": "en", "CREA-Spoken": "es", "CSJ": "ja", "HKUST/MTS": "zh", "ACTIV-ES": "es", "EsPal": "es", "LaboroTV1+2": "ja", "OpenSubtitles": "en es id ja zh", "SubIMDB": "en",
    "SUBTLEX": "en es zh", "SUBTLEX-UK": "en", "GINI": "en ja", "Wikipedia": "en es id ja zh", "wordfreq": "en es id ja zh", "own": "en es id ja zh", "own-regex": "en es id", "own-base": "ja",
    "own-lemma": "en es id ja"}.items() for x in langs.split()]


def registry(paths: dict[tuple[str, str], tuple[str, dict]]) -> list[dict]:
    """Entries of CORPORA, in their order, for which the user has a file: paths maps (name, language) to (path, options of read_frequencies)."""
    if unknown := set(paths) - set(CORPORA):
        raise ValueError(f"unknown corpora {sorted(unknown)}")
    return [dict(name=n, lang=x, path=paths[n, x][0], spec=paths[n, x][1]) for n, x in CORPORA if (n, x) in paths]


def load_corpora(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(name, lang, position, word, count) of all registered lists."""
    out = None
    for k, e in enumerate(entries):
        words, _ = read_frequencies(spark, e["path"], **e["spec"])
        rows = words.select(F.lit(e["name"]).alias("name"), F.lit(e["lang"]).alias("lang"), F.lit(k).alias("position"), "word", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def corpora(spark: SparkSession, registry: list[dict]) -> DataFrame:
    """Dimension table of named corpora: (name, lang, path, spec), spec being the loader's options as JSON."""
    rows = [(r["name"], r["lang"], r["path"], json.dumps(r.get("spec", {}), sort_keys=True), k) for k, r in enumerate(registry)]
    return spark.createDataFrame(rows, "name string, lang string, path string, spec string, position int")
