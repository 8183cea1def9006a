"""Toxicity by a convolutional text classifier, trained in numpy.

Words get the sum of two rows of a hashed embedding table; filters of widths 1 to 3 run over them, each
is max-pooled over the whole text, and a logistic layer gives a logit. Words that the training sample doesn't hold
in MIN_DF texts share one empty embedding. Scores are shifted for each language so that the logit with the best F1 on a
calibration part of the sample falls on score THRESHOLD; the language is predicted from the words of the text.
Since a filter is a sum over its positions, scoring uses word -> filter-part tables: look-ups and
additions only, on whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.sampling import bounded_rows

PER_CLASS = 4000
MAX_TRAIN_CHARS = 20_000
MIN_DF = 3
MAX_WORDS = 30_000
TABLE = 1 << 17
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
THRESHOLD = 0.7
STEPS, MIN_EPOCHS, MAX_EPOCHS = 900, 6, 12
WORD_DROPOUT = 0.15
_SEPARATORS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_POSITIONS = 1 << 17


def words(text: str | None) -> list[bytes]:
    """Lower-case words; every ASCII character that is no letter or digit separates them. Null: none."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split() if text else []


class Model:
    """index: word -> row; parts[width][offset]: (rows, FILTERS) tables; out: weights of the pooled filters."""

    def __init__(self, index: dict[bytes, int], parts: list[list[np.ndarray]], bias: list[np.ndarray], out: np.ndarray, out_bias: float, lang: np.ndarray, shift: np.ndarray) -> None:
        self.index, self.parts, self.bias, self.out, self.out_bias, self.lang, self.shift = index, parts, bias, out, out_bias, lang, shift

    def ids(self, text: str | None) -> np.ndarray:
        get = self.index.get
        return np.fromiter((get(w, 0) for w in words(text)), np.int32)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Max over all windows of one or more joined texts' ids (callers pass one text); in slices, so memory stays bounded."""
        most = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        pad = max(WIDTHS) - 1
        ids = np.concatenate([ids, np.zeros(pad + (not len(ids)), np.int32)])
        for a in range(0, len(ids) - pad, _POSITIONS):
            part = ids[a : a + _POSITIONS + pad]
            for k, width in enumerate(WIDTHS):
                act = self.parts[k][0][part[: len(part) - pad]]
                for j in range(1, width):
                    act += self.parts[k][j][part[j : len(part) - pad + j]]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                np.maximum(most[own], act.max(0), out=most[own])
        return most

    def logit(self, ids: np.ndarray) -> float:
        hidden = np.maximum(self.pooled(ids) + np.concatenate(self.bias), 0)
        return float(hidden @ self.out) + self.out_bias

    def language(self, ids: np.ndarray) -> int:
        return int(self.lang[ids].sum(0).argmax()) if len(ids) and self.lang.shape[1] else 0

    def score(self, text: str | None) -> float:
        ids = self.ids(text)
        z = self.logit(ids) + float(self.shift[self.language(ids)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _rows(word: bytes) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(word, 1) % TABLE, xxhash.xxh32_intdigest(word, 2) % TABLE


def _association(docs: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """z of each word's presence against the label; 0 where it is below what chance gives among so many words."""
    has = np.zeros((2, size))
    for d, t in zip(docs, y):
        has[int(t), np.unique(d)] += 1
    n = np.array([[max((y == 0).sum(), 1)], [max((y == 1).sum(), 1)]])
    share, all_ = has / n, has.sum(0) / n.sum()
    z = (share[1] - share[0]) / np.sqrt(np.maximum(all_ * (1 - all_) * (1 / n).sum(), 1e-9))
    return np.where(np.abs(z) > np.sqrt(2 * np.log(size + 1)), np.clip(z, -16, 16), 0).astype(np.float32)


def _best_shift(logits: np.ndarray, truth: np.ndarray) -> float:
    """Shift that puts the cut of best F1 (middle of its gap) on THRESHOLD."""
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + truth.sum())
    k = int(f1.argmax())
    below = z[k + 1 :][z[k + 1 :] < z[k]]
    cut = (z[k] + below[0]) / 2 if len(below) else z[k] - 1
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def train(texts: list[str], truth: list[int], langs: list[str | None], seed: int = 7) -> Model:
    """Fit on four fifths of the texts, calibrate on the rest. With one class only, every score is that of its share (0 or 1, softened)."""
    split = [words(t) for t in texts]
    y = np.array(truth, np.float32)
    df = Counter(w for s in split for w in set(s))
    known = [w for w, c in sorted(df.items(), key=lambda x: (-x[1], x[0])) if c >= MIN_DF][:MAX_WORDS]
    index = {w: i + 1 for i, w in enumerate(known)}
    one, two = (np.array([TABLE, *(_rows(w)[k] for w in known)]) for k in (0, 1))
    docs = [np.array([index.get(w, 0) for w in s] or [0], np.int32) for s in split]
    names = sorted({x for x in langs if x})
    lang = np.zeros((len(known) + 1, len(names)), np.float32)
    for d, x in zip(docs, langs):
        if x:
            np.add.at(lang[:, names.index(x)], d, 1)
    lang = np.log((lang + 0.1) / (lang + 0.1).sum(0, keepdims=True)) if names else lang
    lang[0] = 0
    rng = np.random.default_rng(seed)
    calibrate = rng.random(len(docs)) < 0.2
    if not len(y) or y.min() == y.max():
        level = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        parts = [[np.zeros((len(known) + 1, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]
        return Model(index, parts, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), level, lang, np.zeros(max(1, len(names))))
    emb = rng.normal(0, 0.1, (TABLE + 1, DIM)).astype(np.float32)
    emb[TABLE] = 0
    emb[:TABLE, 0] = 0
    z = _association(docs, y, len(known) + 1)  # the first dimension starts from how much a word's presence tells
    np.add.at(emb[:, 0], one[1:], z[1:] / 16)
    np.add.at(emb[:, 0], two[1:], z[1:] / 16)
    weights = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in weights:
        w[:, 0] = np.abs(w[:, 0])
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
    dense = [*weights, *bias, out, out_bias]
    first, second, emb_sq, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], np.zeros(TABLE + 1, np.float32), 0
    pad = np.zeros(max(WIDTHS) - 1, np.int32)
    fit = np.flatnonzero(~calibrate)
    balance = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-3), 0.5 / max(1 - y[fit].mean(), 1e-3))
    epochs = min(MAX_EPOCHS, max(MIN_EPOCHS, STEPS * 32 // max(1, len(fit))))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            ids = np.concatenate([np.concatenate([docs[i], pad]) for i in batch])
            starts = np.cumsum([0, *(len(docs[i]) + len(pad) for i in batch)])
            ids[rng.random(len(ids)) < WORD_DROPOUT] = 0
            x = emb[one[ids]] + emb[two[ids]]
            pos, most = [], []
            for k, width in enumerate(WIDTHS):
                act = x @ weights[k][0]
                for j in range(1, width):
                    act[:-j] += x[j:] @ weights[k][j]
                at = np.stack([a + act[a : b - len(pad)].argmax(0) for a, b in zip(starts, starts[1:])])
                pos.append(at)
                most.append(np.take_along_axis(act, at, 0))
            z = np.concatenate(most, 1) + np.concatenate(bias)
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -30, 30)))
            err = ((p - y[batch]) * balance[batch] / len(batch)).astype(np.float32)
            back = np.outer(err, out) * (z > 0)
            grads = [np.zeros_like(w) for w in weights] + [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [hidden.T @ err, err.sum(keepdims=True)]
            rows, changes = [], []
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    spot = pos[k] + j
                    for f in range(FILTERS):
                        grads[k][j, :, f] = x[spot[:, f]].T @ g[:, f]
                        rows.append(ids[spot[:, f]])
                        changes.append(g[:, f, None] * weights[k][j, :, f])
            step += 1
            for p_, g, m, v in zip(dense, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            hit, change = np.concatenate(rows), np.concatenate(changes)
            live = np.abs(change).sum(1) > 0
            uniq, inv = np.unique(hit[live], return_inverse=True)
            total = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(total, inv, change[live])
            for table in (one, two):
                t = table[uniq]
                keep = t < TABLE
                np.add.at(emb_sq, t[keep], (total[keep] ** 2).mean(1))
                np.add.at(emb, t[keep], -0.05 * total[keep] / (np.sqrt(emb_sq[t[keep]])[:, None] + 1e-8))
    vectors = emb[one] + emb[two]
    vectors[0] = 0
    parts = [[vectors @ w[j] for j in range(w.shape[0])] for w in weights]
    model = Model(index, parts, bias, out, float(out_bias[0]), lang, np.zeros(max(1, len(names))))
    held = np.flatnonzero(calibrate)
    logits, truths = np.array([model.logit(docs[i]) for i in held]), y[held]
    spoken = np.array([model.language(docs[i]) for i in held])
    common = _best_shift(logits, truths) if truths.any() else 0.0
    for k in range(len(model.shift)):
        own = spoken == k
        model.shift[k] = _best_shift(logits[own], truths[own]) if truths[own].sum() >= 20 else common
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", keep=None, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Model of a sample bounded by per_class texts of at most max_chars of each label. Ids with several labels count with the largest; null labels don't count.

    lang_col is read for the calibration only.
    """
    rows = labels.filter(keep) if keep is not None else labels
    classes = rows.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label")).filter(F.col("_label").isin(0, 1))
    sample = bounded_rows(docs, classes, id_col, text_col, "_label", per_class, max_chars).join(
        docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")), "_id", "left") if lang_col in docs.columns else bounded_rows(docs, classes, id_col, text_col, "_label", per_class, max_chars).withColumn("_lang", F.lit(None).cast("string"))
    got = sorted(sample.dropDuplicates(["_id"]).collect(), key=lambda r: str(r["_id"]))
    return train([r["_text"] for r in got], [r["_class"] for r in got], [r["_lang"] for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row from its whole text; no shuffle. Null and empty texts get the score of a text without known words.

    Repeated rows give repeated rows; no other column is read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([shared.value.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
