"""Which tokenizer applies: language, tokenization, form and tagging. External models plug in; regular expressions and the treebank conventions are built in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions import python_text
from corpusfreq.functions import text as T

Tokenizer = Callable[[Column], Column]
_PLUGINS: dict[str, Callable[[str], list[str]]] = {}
_TAGGERS: dict[str, Callable[[str], list[tuple[str, str]]]] = {}
NATIVE = {"ja", "zh"}


def register(name: str, tokenize: Callable[[str], list[str]] | None = None, tag: Callable[[str], list[tuple[str, str]]] | None = None) -> None:
    """Make an external model available under a name such as stanza, treebank, mecab or jieba; it runs in Arrow batches."""
    if tokenize:
        _PLUGINS[name] = tokenize
    if tag:
        _TAGGERS[name] = tag


def choose(lang: str, tokenization: str | None = None, form: str = "surface", pos: bool = False) -> str:
    """Name of the tokenizer. Japanese and Chinese take their own only; the treebank one is English; regular expressions and treebank can't tag or lemmatise."""
    name = tokenization or {"ja": "mecab", "zh": "jieba"}.get(lang, "stanza")
    if lang in NATIVE and tokenization not in (None, "mecab", "jieba"):
        raise ValueError(f"{lang} has a tokenizer of its own")
    if name == "treebank" and lang != "en":
        raise ValueError("treebank tokenization is English")
    if name in ("regex", "treebank") and (pos or form != "surface"):
        raise ValueError(f"{name} tokenization gives neither parts of speech nor lemmas")
    if form not in ("surface", "base", "lemma") or form == "base" and lang != "ja":
        raise ValueError(f"no form {form} in {lang}")
    return name


def dedup_choice(lang: str) -> str:
    """Tokenizer of the deduplication stage."""
    return {"en": "treebank", "ja": "mecab", "zh": "jieba"}.get(lang, "regex")


def tokenizer(name: str, fallback: bool = False) -> Tokenizer:
    """Column function of a tokenizer; where the model isn't registered, an error, or the regular-expression one if fallback asks for it."""
    if name == "regex":
        return T.tokens
    if name == "treebank" and name not in _PLUGINS:
        return python_text.treebank_tokens
    f = _PLUGINS.get(name)
    if f is None:
        if not fallback:
            raise LookupError(f"register a tokenizer {name}")
        return T.tokens

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else list(f(x)))

    return run


def tagger(name: str) -> Tokenizer:
    """Column function to array<struct<token, pos>>; missing parts of speech are N/A."""
    f = _TAGGERS.get(name)
    if f is None:
        raise LookupError(f"register a tagger {name}")

    @F.pandas_udf("array<struct<token: string, pos: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"token": t, "pos": p or "N/A"} for t, p in f(x)])

    return run


def extended_pos(tagged: DataFrame, compounds: DataFrame, mimetics: DataFrame) -> DataFrame:
    """Japanese tags refined by dictionaries: (doc, pos_no, token, reading, pos) with verbs whose reading is a listed compound as COMPOUND_VERB and listed mimetic words as MIMETIC.

    The dictionaries are tables (reading) and (word), supplied by the user.
    """
    c, m = compounds.select("reading").distinct().withColumn("_c", F.lit(True)), mimetics.select(F.col("word").alias("token")).distinct().withColumn("_m", F.lit(True))
    out = tagged.join(c, "reading", "left").join(m, "token", "left")
    pos = F.when(F.col("_c") & (F.col("pos") == "VERB"), "COMPOUND_VERB").when(F.col("_m"), "MIMETIC").otherwise(F.col("pos"))
    return out.withColumn("pos", pos).select(*tagged.columns)
