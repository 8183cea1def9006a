"""Quality by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are texts labelled good; unlabelled texts are drawn from the whole web text whatever
their label. A small network in numpy minimises  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  under the sigmoid
loss, with the class prior pi estimated from how the score's distribution among the unlabelled exceeds that of held-back positives.
The inputs are hashed n-grams of the whole text (four bytes; one and two words): of TABLE buckets those that set positives apart from the unlabelled
beyond what chance gives, SELECTED at most. Numbers that describe the text (character classes, repetition, compressibility) stand beside them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.sampling import bounded_rows

PER_CLASS = 6000
MAX_TRAIN_CHARS = 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 2000, 256, 0.01, 3e-3
TABLE, SELECTED, GRAM_WEIGHT = 1 << 16, 1024, 0.2
_PIECE = 1 << 21
_POWERS = np.random.default_rng(6).integers(1, 1 << 32, 64, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_IN_WORD = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
_ASCII = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.uint8)  # 0 other control, 1 space, 2 newline, 3 lower, 4 upper, 5 digit, 6 beyond ASCII, 7.. marks
for _c in range(256):
    _CLASS[_c] = 1 if _c in (32, 9) else 2 if _c == 10 else 3 if 97 <= _c <= 122 else 4 if 65 <= _c <= 90 else 5 if 48 <= _c <= 57 else 6 if _c > 127 else 7 + _ASCII.index(_c) if _c in _ASCII else 0
N_CLASSES = 7 + len(_ASCII)


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; those of null are those of the empty text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES) / n
    low = raw.lower().split()
    m = max(1, len(low))
    counts = Counter(low)
    top = counts.most_common(1)[0][1] if counts else 0
    same = sum(a == b for a, b in zip(low, low[1:]))
    marked = sum(not (w[-1] > 127 or chr(w[-1]).isalnum()) for w in low)
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    lines = raw.split(b"\n")
    packed = len(zlib.compress(raw, 1))
    marks = np.sqrt(share[7:])
    return np.concatenate([marks, share[1:7], [
        np.log1p(n) / 10, n / m / 10, same / m, top / m, len(counts) / m, np.log1p(len(counts)) / np.log1p(m), marked / m, short / m,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, packed / n, np.log(packed / n**0.95 + 1e-3),
    ]])


def _buckets(b: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of lower-case bytes."""
    out = []
    if len(b) >= 4:
        c = b.astype(np.uint32)
        four = c[:-3] | c[1:-2] << np.uint32(8) | c[2:-1] << np.uint32(16) | c[3:] << np.uint32(24)
        out.append((four * np.uint32(0x9E3779B1)) >> np.uint32(16))
    inside = _IN_WORD[b]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(starts):
        at = np.flatnonzero(inside)
        word = np.searchsorted(starts, at, "right") - 1
        first = np.searchsorted(at, starts)
        h = np.add.reduceat((b[at].astype(np.uint32) + np.uint32(1)) * _POWERS[np.minimum(at - starts[word], 63)], first, dtype=np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((h ^ np.uint32(0x5BD1E995)) >> np.uint32(16))
        out.append(((h[:-1] * np.uint32(31) + h[1:]) * np.uint32(0xC2B2AE35)) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def grams(text: str | None, pick: np.ndarray | None = None, size: int = TABLE) -> np.ndarray:
    """Rate of each bucket among the text's n-grams, in thousandths, log1p. pick: place of each bucket among `size`, or size for none.

    Long texts go in pieces cut at blanks, whose counts add up; only pairs of words across a cut aren't counted."""
    raw = (text or "").lower().encode("utf-8", "replace")
    counts, total, at = np.zeros(size + 1), 0, 0
    while at < len(raw):
        end = len(raw) if at + _PIECE >= len(raw) else max(raw.rfind(b" ", at, at + _PIECE), at + _PIECE // 2)
        h = _buckets(np.frombuffer(raw, np.uint8, end - at, at))
        counts += np.bincount(h if pick is None else pick[h], minlength=size + 1)
        total, at = total + len(h), end
    return np.log1p(counts[:size] * (1000 / max(1, total)))


class Model:
    """buckets: the selected ones. Inputs are features, then rates of the buckets."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], prior: float, buckets: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.prior, self.buckets = mean, scale, weights, prior, buckets
        self.pick = np.full(TABLE, len(buckets), np.int64)
        self.pick[buckets] = np.arange(len(buckets))

    def inputs(self, text: str | None) -> np.ndarray:
        return np.concatenate([features(text), grams(text, self.pick, len(self.buckets))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ a + b) @ c + d

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.concatenate([self.raw(np.stack([self.inputs(t) for t in texts[k : k + 256]])) for k in range(0, len(texts), 256)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(pos: list[str], free: list[str]) -> np.ndarray:
    """Buckets whose presence differs between positives and unlabelled texts by more than chance gives among TABLE of them, SELECTED of greatest difference at most."""
    has = np.zeros((2, TABLE))
    for k, texts in enumerate((pos, free)):
        for t in texts:
            has[k] += grams(t) > 0
    n = np.array([[max(1, len(pos))], [max(1, len(free))]])
    share, all_ = has / n, has.sum(0) / n.sum()
    z = np.abs(share[0] - share[1]) / np.sqrt(np.maximum(all_ * (1 - all_) * (1 / n).sum(), 1e-9))
    order = np.argsort(-z, kind="stable")[:SELECTED]
    return np.sort(order[z[order] > np.sqrt(2 * np.log(TABLE))])


def _fit(pos: np.ndarray, free: np.ndarray, prior: float, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros((), np.float32)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]

    def back(x: np.ndarray, sign: float) -> tuple[float, list[np.ndarray]]:
        """Mean sigmoid loss of calling x sign, and its gradients."""
        h = np.tanh(x @ w[0] + w[1])
        loss = 1 / (1 + np.exp(np.clip(sign * (h @ w[2] + w[3]), -30, 30)))
        g = (-sign * loss * (1 - loss) / len(x)).astype(np.float32)
        gh = np.outer(g, w[2]) * (1 - h * h)
        return float(loss.mean()), [x.T @ gh, gh.sum(0), h.T @ g, g.sum()]

    for step in range(1, STEPS + 1):
        p = pos[rng.integers(0, len(pos), min(BATCH, len(pos)))]
        u = free[rng.integers(0, len(free), min(BATCH * 2, len(free)))]
        (_, gp), (lost, gn), (other, gu) = back(p, 1), back(p, -1), back(u, -1)
        if other - prior * lost >= 0:
            grads = [prior * a + c - prior * b for a, b, c in zip(gp, gn, gu)]
        else:  # the risk of negatives went below 0: step back from it
            grads = [prior * b - c for b, c in zip(gn, gu)]
        for k, g in enumerate(grads):
            g = g + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = (w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(pos: np.ndarray, free: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores: least ratio, over cuts t, of the shares scoring at least t,
    each with the standard error that its sample size leaves."""
    cuts = np.quantile(pos, np.linspace(0.02, 0.9, 60))
    p = np.array([(pos >= t).mean() for t in cuts])
    u = np.array([(free >= t).mean() for t in cuts])
    slack = np.sqrt(p * (1 - p) / len(pos)) + np.sqrt(u * (1 - u) / len(free))
    return float(np.clip(np.min((u + slack) / np.maximum(p, 1e-9)), 0.05, 0.99))


def train(pos: list[str], free: list[str], seed: int = 11) -> Model:
    """Network and prior. Without positives or unlabelled texts every score is 0.5."""
    if not pos or not free:
        width = len(features(""))
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(())], 0.5, np.zeros(0, np.int64))
    blank = Model(np.zeros(0), np.ones(0), [], 0.5, select(pos, free))
    x, u = (np.stack([blank.inputs(t).astype(np.float32) for t in texts]) for texts in (pos, free))
    mean, scale = u.mean(0), u.std(0) + 1e-3
    scale[len(features("")):] /= GRAM_WEIGHT
    for part in (x, u):
        part -= mean
        part /= scale
        np.clip(part, -6, 6, out=part)
    cut, half = max(1, len(x) * 3 // 4), max(1, len(u) * 3 // 4)
    trial = Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), _fit(x[:cut], u[:half], 0.5, seed), 0.5, blank.buckets)
    prior = estimate_prior(trial.raw(x[cut:] if len(x) > cut else x), trial.raw(u[half:] if len(u) > half else u))  # of texts that the trial hasn't seen
    return Model(mean, scale, _fit(x, u, prior, seed + 1), prior, blank.buckets)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep=None, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Model of at most per_class trusted positives (label 1 under keep) and per_class unlabelled texts, drawn by hash of the id from
    all documents, labels unseen; both of at most max_chars. Null and other labels are no positives."""
    rows = labels.filter(keep) if keep is not None else labels
    good = rows.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("_label")).filter("_label = 1")
    free = docs.select(F.col(id_col)).distinct().withColumn("_label", F.lit(2))
    got = {1: [], 2: []}
    for classes in (good, free):
        for r in sorted(bounded_rows(docs, classes, id_col, text_col, "_label", per_class, max_chars).collect(), key=lambda r: str(r["_id"])):
            got[r["_class"]].append(r["_text"])
    return train(got[1], got[2])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row from its whole text; no shuffle. Null counts as the empty text; repeated
    rows give repeated rows; no other column is read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = shared.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
