"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.llm import decontamination, embeddings, htmltext, language_id, lines, minhash, mixing, quality, toxicity, warc
from corpusfreq.llm.sampling import remainder
from corpusfreq.session import scratch_path, table


#: Target weights, as shares; other sources have one share each.
SHARES = {"src0": 12, "src1": 6, "src2": 6, "src3": 5, "src4": 4, "src5": 4, "src6": 3, "src7": 3, "src8": 2, "src9": 2}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SHARES)


def mixing_sql(docs: str, columns: str, shares: dict[str, int]) -> str:
    """SQL of mixing.mix over the relation docs, returning columns and the three places."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in shares.items())
    return f"""
WITH RECURSIVE d0 AS (SELECT *, coalesce('=' || source, '') AS key, md5(CAST(doc_id AS VARCHAR)) AS h FROM {docs}),
sh AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS s, CASE substr(key, 2) {cases} ELSE 1 END AS n FROM (SELECT DISTINCT key FROM d0)),
tot AS (SELECT list(n ORDER BY s) AS ns, CAST(sum(n) AS BIGINT) AS w, count(*) AS c FROM sh),
sim(t, k, p) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ns, lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT) FROM tot
  UNION ALL
  SELECT t + 1, list_transform(range(1, c + 1), lambda i: k[i] + CASE WHEN i = q THEN 1 ELSE 0 END), q - 1
  FROM (SELECT t, k, c, w, list_min(list_filter(list_transform(range(1, c + 1), lambda i: CASE WHEN (k[i] * w) // ns[i] <= t + 1
      THEN {{'d': ((k[i] + 1) * w + ns[i] - 1) // ns[i], 'i': i}} END), lambda x: x IS NOT NULL)).i AS q FROM sim, tot WHERE t + 1 < w)),
lay AS (SELECT t AS slot, p AS s, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS occ FROM sim WHERE t >= 0),
r AS (SELECT d0.*, sh.s, sh.n, row_number() OVER (PARTITION BY d0.key ORDER BY h, doc_id) - 1 AS rk FROM d0 JOIN sh USING (key)),
b AS (SELECT r.*, rk // {mixing.BLOCK_ROWS} AS block, (rk // {mixing.BLOCK_ROWS}) // n * (SELECT w FROM tot) + slot AS mix_slot
      FROM r JOIN lay ON lay.s = r.s AND lay.occ = (rk // {mixing.BLOCK_ROWS}) % n),
o AS (SELECT mix_slot, row_number() OVER (ORDER BY mix_slot) - 1 AS mix_position FROM (SELECT DISTINCT mix_slot FROM b))
SELECT {columns}, CAST(b.mix_slot AS BIGINT) AS mix_slot, CAST(o.mix_position AS BIGINT) AS mix_position, CAST(rk % {mixing.BLOCK_ROWS} AS INTEGER) AS mix_index
FROM b JOIN o ON o.mix_slot = b.mix_slot"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.read(spark, path, payload="digest").filter(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^urn:row:(-?\d+)$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.coalesce("computed_digest", "payload_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), keep=remainder("doc_id", 3) != 1)
    return quality.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), shingle=2)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON m.id = doc_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, keep=language_id.training_rows())
    found = language_id.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
c AS (SELECT u, count(*) AS n FROM l GROUP BY u),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT l.w, r.root FROM r JOIN l ON l.u = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e LEFT JOIN c ON c.u = vec_id JOIN m ON m.id = vec_id
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lines.remove_duplicate_lines(docs, length_col="n_chars")
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql("documents", "doc_id, source", SHARES), "op7_minhash": OP7_SQL, "op9_embedding_dedup": OP9_SQL}
