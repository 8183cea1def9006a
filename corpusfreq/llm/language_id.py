"""Language identification by prediction by partial matching (PPM).

Each language has byte context trees of order 0 to ORDER with escape method C, built from a bounded sample and
then frozen. A text's exact code length under every language is the sum over its bytes of: the bits of
the byte in the deepest context that the tree holds, after the bits of an escape for each context that does not
hold the byte; below order 0 each byte costs 8 bits. The contexts and bytes that the trees hold are kept in hash tables with the bits of
every language, so that scoring is a look-up a byte in numpy, and one more for each escape from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.sampling import bounded_rows, remainder

ORDER = 3
PER_LANGUAGE = 400
MAX_TRAIN_CHARS = 20_000
_PAD = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 18


class _Table:
    """Row of each of some distinct keys, found by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]  # one key a free slot
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            slot, todo = (slot[rest] + 1) & (len(self.keys) - 1), todo[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        rows = np.where(held == keys, self.rows[slot], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot_, key = (slot[todo] + 1) & (len(self.keys) - 1), keys[todo]
            slot[todo], held = slot_, self.keys[slot_]
            same = held == key
            rows[todo[same]] = self.rows[slot_[same]]
            todo = todo[~same & (held >= 0)]
        return rows


class Model:
    """Trees of all languages. symbol: of each byte; edges: (order, context, symbol) that any language holds, with the bits in each language; contexts: (order, context), with
    the bits of an escape. What the trees hold is stored, whatever the alphabet; both are narrow tables of one column a language."""

    def __init__(self, languages: list[str], symbol: np.ndarray, size: int, edges: np.ndarray, bits: np.ndarray, contexts: np.ndarray, escapes: np.ndarray) -> None:
        self.languages, self.symbol, self.size, self.bits, self.escapes = languages, symbol, size, bits, escapes
        self.edges, self.contexts = _Table(edges), _Table(contexts)

    def costs(self, s: np.ndarray) -> np.ndarray:
        """Bits of each symbol after the first ORDER ones."""
        n = len(s) - ORDER
        left, sym, out = np.arange(n), s[ORDER:], np.zeros((n, len(self.languages)), np.float32)
        for order in range(ORDER, -1, -1):
            ctx = _packed([s[left + k] for k in range(ORDER - order, ORDER)], self.size, len(left))
            row = self.edges.find(ctx * self.size + sym[left] + _offset(order, self.size, 1))
            hit = row >= 0
            out[left[hit]] += self.bits[row[hit]]
            left, ctx = left[~hit], ctx[~hit]
            if not len(left):
                return out
            row = self.contexts.find(ctx + _offset(order, self.size, 0))
            known = row >= 0
            out[left[known]] += self.escapes[row[known]]
        out[left] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language, as float64 of shape (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + ORDER for t in texts)])
        for a in range(0, len(data), _SLICE):
            b, lo = min(len(data), a + _SLICE), max(0, a - ORDER)
            part = self.symbol[data[lo:b]]
            cost = self.costs(np.concatenate([np.zeros(ORDER - (a - lo), np.int64), part]))
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b, "left"))
            cut = starts[first:last]
            for k in range(ORDER):  # the padding costs nothing
                pads = cut + k
                cost[pads[(pads >= a) & (pads < b)] - a] = 0
            out[first:last] += np.add.reduceat(cost, np.maximum(cut, a) - a, axis=0, dtype=np.float64)
        return out


def _packed(symbols: list[np.ndarray], size: int, n: int) -> np.ndarray:
    ctx = np.zeros(n, np.int64)
    for x in symbols:
        ctx = ctx * size + x
    return ctx


def _offset(order: int, size: int, own: int) -> int:
    """Where the keys of an order begin: those of (context, symbol) for own = 1, of contexts for 0."""
    return sum(size ** (k + own) for k in range(order))


def train(samples: dict[str, list[str]]) -> Model:
    """Count contexts of each language's sample; store what they hold. No samples: a model without languages."""
    languages = sorted(samples)
    texts = [[_PAD + t.lower().encode("utf-8", "replace") for t in samples[x]] for x in languages]
    seen = np.zeros(256, bool)
    seen[10] = True
    for own in texts:
        for t in own:
            seen[np.frombuffer(t, np.uint8)] = True
    size = int(seen.sum()) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[seen] = np.arange(size - 1)
    grams = []
    for own in texts:
        parts = [symbol[np.frombuffer(t, np.uint8)] for t in own]
        grams.append(np.concatenate([((p[:-3] * size + p[1:-2]) * size + p[2:-1]) * size + p[3:] for p in parts]) if parts else np.zeros(0, np.int64))
    keys, bits, contexts, escapes = [], [], [], []
    lower, below = np.zeros(0, np.int64), np.zeros((0, len(languages)))
    for order in range(ORDER + 1):
        span = size ** (order + 1)
        own = [np.unique(g % span, return_counts=True) for g in grams]
        edges = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.int64)
        ctx = np.unique(edges // size)
        at = np.searchsorted(ctx, edges // size)
        under = below[np.searchsorted(lower, edges % (span // size))] if order else np.full((len(edges), len(languages)), 8.0)
        cost, escape = np.empty((len(edges), len(languages))), np.zeros((len(ctx), len(languages)))
        for k, (found, n) in enumerate(own):
            count = np.zeros(len(edges))
            count[np.searchsorted(edges, found)] = n
            total, kinds = np.bincount(at, count, len(ctx)), np.bincount(at, count > 0, len(ctx))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, k] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                cost[:, k] = np.where(count > 0, -np.log2(count / (total + kinds)[at]), escape[at, k] + under[:, k])
        keys.append(edges + _offset(order, size, 1))
        bits.append(cost.astype(np.float32))
        contexts.append(ctx + _offset(order, size, 0))
        escapes.append(escape.astype(np.float32))
        lower, below = edges, cost
    return Model(languages, symbol, size, np.concatenate(keys), np.concatenate(bits), np.concatenate(contexts), np.concatenate(escapes))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep=None, per_language: int = PER_LANGUAGE, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Model of a sample bounded by per_language texts of at most max_chars for each language (keep: condition on rows)."""
    rows = docs.filter(keep) if keep is not None else docs
    classes = rows.groupBy(id_col).agg(F.min(lang_col).alias("_lang")).filter(F.col(id_col).isNotNull())
    samples: dict[str, list[str]] = {}
    for r in bounded_rows(rows, classes, id_col, text_col, "_lang", per_language, max_chars).collect():
        samples.setdefault(r["_class"], []).append(r["_text"])
    return train(samples)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language of least code length (ties: the first by name) and a score, 1 / sum over languages of
    2 ** -(excess bits / sqrt(bytes)). Null texts, and texts without a letter, are `und` with score 0."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
    group: list[int] = []
    data: list[bytes] = []
    held = 0
    for i in [*todo, None]:
        if i is not None:
            group.append(i)
            data.append(texts[i].lower().encode("utf-8", "replace"))
            held += len(data[-1])
        if group and (i is None or held > 4 * _SLICE):
            cost = model.code_lengths(data)
            best = cost.argmin(1)
            over = (cost - cost[np.arange(len(group)), best][:, None]) / np.sqrt([[len(d)] for d in data])
            scores[group] = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)
            for j, at in enumerate(group):
                langs[at] = model.languages[best[j]]
            group, data, held = [], [], 0
    return langs, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; whole texts, no shuffle.

    Null or letterless texts (the empty one too) give `und`, 0.0; repeated rows give repeated rows; a null id stays null;
    an empty table gives no rows. Other columns aren't read, so their names can't clash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of at least `least`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                langs, scores = predict(shared.value, part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(score, docs.schema)


def training_rows(id_col: str = "doc_id"):
    return remainder(id_col, 4) != 2
