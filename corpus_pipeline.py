"""Pipeline that turns documents into a mixed training corpus, by the operators of corpusfreq.llm.

STAGES run in order; each works on all rows that the one before kept and, but for the last, returns the columns of documents.
Rows that repeat a doc_id are treated alike. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.llm import decontamination, language_id, lines, minhash, mixing
from corpusfreq.llm.queries import SHARES
from corpusfreq.session import materialize, table

#: A language must have this score; far below that of clean documents, above texts without letters.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model can tell go (null, empty and letterless ones too)."""
    model = language_id.fit(docs, keep=language_id.training_rows())
    return language_id.keep_identified(docs, model, least=LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later documents lose the blocks of lines that stand in an earlier one; those of which nothing is left go."""
    return lines.remove_duplicate_lines(docs, length_col="n_chars").filter("text <> ''")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document of the least id stays."""
    gone, _ = materialize(minhash.components(docs).filter(~F.col("kept")).select("doc_id").distinct(), "near")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in the mixture."""
    return mixing.mix(docs, SHARES)


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The language model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialize(docs, "stage")
    return docs
