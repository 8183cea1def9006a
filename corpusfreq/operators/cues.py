"""Subtitle files to cues, cues to clean lines, and the filters and counts of the cleaning stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions import text as T

_TS = r"(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})"
TIMING = rf"^{_TS}[ \t]+-->[ \t]+{_TS}(?:[ \t\n]|$)"


def timing(line: Column) -> Column:
    """struct(start, end) in seconds of a timing line; null where it is none or minutes or seconds reach 60."""
    part = lambda k: F.regexp_extract(line, TIMING, k)

    def seconds(k: int) -> Column:
        h = F.when(part(k) == "", F.lit(0)).otherwise(part(k).try_cast("long"))
        return h * 3600 + part(k + 1).try_cast("int") * 60 + part(k + 2).try_cast("int") + part(k + 3).try_cast("int") / 1000

    good = line.rlike(TIMING) & (part(2).try_cast("int") < 60) & (part(3).try_cast("int") < 60) & (part(6).try_cast("int") < 60) & (part(7).try_cast("int") < 60)
    return F.when(good, F.struct(seconds(1).alias("start"), seconds(5).alias("end")))


def parse_cues(files: DataFrame, id_col: str = "video_id", text_col: str = "vtt") -> DataFrame:
    """(id, idx, start, end, raw) of each cue. A cue runs from a valid timing line to a blank line, a line with --> or the end; without
    lines its text is empty. Lines after anything but a valid timing are passed over."""
    lines = files.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("n", "line"))
    by = Window.partitionBy("id").orderBy("n")
    stop = (F.col("line") == "") | F.contains(F.col("line"), F.lit("-->"))
    lines = lines.withColumn("stop", stop).withColumn("t", F.when(F.contains(F.col("line"), F.lit("-->")), timing(F.col("line"))))
    lines = lines.withColumn("island", F.sum(F.col("stop").cast("int")).over(by))
    cues = lines.groupBy("id", "island").agg(
        F.min("n").alias("idx"), F.max("t").alias("t"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("stop"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("raw"))
    return cues.filter("t IS NOT NULL").select(F.col("id").alias(id_col), "idx", "t.start", "t.end", "raw")


def clean_cues(cues: DataFrame, id_col: str = "video_id", order: list[str] | None = None, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """(id, order..., kind, emitted): what each cue adds. kind is empty, delay, repeat, scroll or other; emitted an array of lines.

    Compared with the last cue that had text: a start after its end gives an empty line and the text; the same text gives nothing; a text that scrolls on
    gives its last line (nothing if it has one only); any other the text. One window by video; no state beyond `lag`.
    """
    order = order or ["idx"]
    said = F.trim(F.regexp_replace(F.col(text), rf"^{T.SPACE}+|{T.SPACE}+$", ""))
    rows = cues.select(F.col(id_col), *order, F.col(start).alias("_s"), F.col(end).alias("_e"), F.coalesce(said, F.lit("")).alias("_t"))
    by = Window.partitionBy(id_col, F.col("_t") == "").orderBy(*order)
    rows = rows.withColumn("_pe", F.lag("_e").over(by)).withColumn("_pt", F.lag("_t").over(by))
    lines = F.split("_t", "\n")
    head = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n")).otherwise(F.col("_t"))
    tail = F.expr("substring(_pt, instr(_pt, '\n') + 1)")  # without its first line, or the one line itself
    kind = (F.when(F.col("_t") == "", "empty").when(F.col("_pt").isNull(), "other").when(F.col("_s") > F.col("_pe"), "delay")
            .when(F.col("_t") == F.col("_pt"), "repeat").when((head == tail) | (head == F.col("_pt")), "scroll").otherwise("other"))
    rows = rows.withColumn("kind", kind)
    emitted = (F.when(F.col("kind") == "delay", F.array(F.lit(""), F.col("_t"))).when(F.col("kind") == "other", F.array("_t"))
               .when((F.col("kind") == "scroll") & (F.size(lines) > 1), F.array(F.element_at(lines, -1))).otherwise(F.array().cast("array<string>")))
    return rows.select(id_col, *order, "kind", emitted.alias("emitted"))


def cue_stats(kinds: DataFrame, id_col: str = "video_id") -> DataFrame:
    one = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return kinds.groupBy(id_col).agg(F.count("*").alias("n_cues"), *(one(k) for k in ("empty", "repeat", "scroll", "delay", "other")))


def lines_of(kinds: DataFrame, id_col: str, order: list[str], delays: bool = True, normalize: bool = True, new_lines: bool = False) -> DataFrame:
    """(id, order..., pos, line) of the emitted lines, empty ones marking delays unless they are switched off; white space normalised line by line; new_lines: each ends in a line feed."""
    out = kinds.select(id_col, *order, F.posexplode("emitted").alias("pos", "line"))
    if not delays:
        out = out.filter("line <> ''")
    out = out.withColumn("line", T.normalize_space(F.col("line"))) if normalize else out
    return out.withColumn("line", F.concat("line", F.lit("\n"))) if new_lines else out


def clean_lines(lines: DataFrame, id_col: str, charset: str, ratio_col: str | None = None) -> DataFrame:
    """Per video: tags removed, lines dropped because they are empty then or hold no character of the language, lines kept (delays too),
    lines with text, and the share of the language's characters over kept lines."""
    text = F.col("line")
    stripped = T.normalize_space(T.strip_invalid_tags(text))
    rows = lines.select(id_col, text.alias("line"), T.count_invalid_tags(text).alias("tags"), stripped.alias("s"))
    rows = rows.withColumn("delay", F.col("line") == "").withColumn("blank", ~F.col("delay") & F.col("s").isin("", " "))
    rows = rows.withColumn("own", T.chars_in(F.col("s"), charset))
    rows = rows.withColumn("foreign", ~F.col("delay") & ~F.col("blank") & (F.col("own") == 0))
    kept = ~F.col("blank") & ~F.col("foreign")
    return rows.groupBy(id_col).agg(
        F.sum("tags").alias("n_tags"), F.count_if("blank").alias("n_blank"), F.count_if("foreign").alias("n_nonl"), F.count_if(kept).alias("n_lines"),
        F.count_if(kept & ~F.col("delay")).alias("n_text"),
        F.coalesce(F.sum(F.when(kept, F.col("own"))) / F.nullif(F.sum(F.when(kept, F.length("s"))), F.lit(0)), F.lit(0.0)).alias("charset_ratio"))


def reason(n_text: Column, charset_ratio: Column, lang_ratio: Column, min_lines: int = 3, min_charset: float = 0.7, min_lang: float = 0.95) -> Column:
    """First filter that a file fails: short, charset, lang; valid if none."""
    return F.when(n_text < min_lines, "short").when(charset_ratio < min_charset, "charset").when(lang_ratio < min_lang, "lang").otherwise("valid")


def lang_ratio(lines: DataFrame, id_col: str, own: Column) -> DataFrame:
    """Share of characters in lines for which `own` holds; own is any line classifier."""
    return lines.groupBy(id_col).agg(F.coalesce(F.sum(F.when(own, F.length("line")).otherwise(0)) / F.nullif(F.sum(F.length("line")), F.lit(0)), F.lit(0.0)).alias("lang_ratio"))


def funnel(marked: DataFrame, counters: list[str]) -> DataFrame:
    """(reason, files, counters...) with the counters summed by reason."""
    return marked.groupBy("reason").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in counters))
