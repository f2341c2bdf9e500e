"""Quality by Naive Bayes support vectors (op5).

Features are indicators of hashed n-grams: single words and pairs of words, and runs of one to three word shapes
(a shape keeps a token's kinds of characters, such as Aa., A!! or a###), which see junk that words alone
don't. Indicators are scaled by the classes' smoothed log-count ratio, and a linear model is fitted to
the scaled indicators by dual coordinate descent on the L2-regularised hinge loss. The decision value
becomes a score by a logistic curve fitted on labelled documents that the model has not seen.

Labels come from the training fold alone (crc32 of the doc_id as text, modulo 5, not 0). Fitting
takes at most ``MAX_EACH`` labelled documents of either class, those of the smallest hashes of their ids, each in
full and one for each id; of either class, those after the one with which ``MAX_BYTES`` of indicators are reached are left out. The model has a fixed size and is broadcast; scoring reads every whole text in one pass without a shuffle.

Defined results: null and empty texts have no features and get the score of the intercept alone; without
labels of both classes every score is 0.5; repeated labels of an id count once, as do texts that share one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table
from .toxicity import bounded_features, fold, labelled_sample
from .wordhash import hash_words, mix

FOLDS, HELD_OUT = 5, 0
MAX_EACH = 4_000
#: Indicators of the sample that go to the driver, at 4 bytes each.
MAX_BYTES = 48 << 20
BUCKETS, ALPHA, COST, EPOCHS = 1 << 18, 1.0, 0.1, 12
_SPAN = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)

#: Byte -> kind of character: lower a, upper A, digit 0, blank, other bytes of letters a, punctuation as it is.
_SHAPE = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else 0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def _grams(h: np.ndarray, text: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbours within a text, and their texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, salt, np.uint64)
    for k in range(n):
        out = mix(out * _M + h[k : len(h) - n + 1 + k])
    same = text[: len(out)] == text[n - 1 :]
    return out[same], text[: len(out)][same]


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of token shapes, runs of one kind of character counting as one, and their texts."""
    raw = [t.encode("utf-8", "replace").translate(_SHAPE) for t in texts]
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    text = np.repeat(np.arange(len(raw)), [len(x) + 1 for x in raw])
    text = np.append(text, len(raw) - 1) if len(text) < len(b) else text
    keep = np.ones(len(b), bool)
    keep[1:] = b[1:] != b[:-1]
    b, text = b[keep], text[keep]
    blank = b == 0x20
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    value = np.zeros(len(starts), np.uint64)
    length = np.minimum(ends - starts, 8)
    for k in range(8):
        on = length > k
        value[on] = value[on] * np.uint64(257) + b[starts[on] + k]
    return mix(value), text[np.minimum(starts, len(text) - 1)] if len(starts) else np.zeros(0, np.int64)


def indicators(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first's place, buckets (sorted and distinct within each text) and offsets."""
    clean = [t or "" for t in texts]
    for run in hash_words(clean, _SPAN):
        n = len(run.offsets) - 1
        text = np.repeat(np.arange(n), run.counts())
        shapes, shape_text = _shapes(clean[run.first : run.first + n])
        parts = [_grams(run.hashes, text, k, k) for k in (1, 2)] + [_grams(shapes, shape_text, k, 16 + k) for k in (1, 2, 3)]
        again = np.flatnonzero((run.hashes[1:] == run.hashes[:-1]) & (text[1:] == text[:-1])) if len(text) > 1 else np.zeros(0, np.int64)
        parts.append((np.full(len(again), 99, np.uint64), text[again]))  # a word beside itself
        where = np.concatenate([p[1] for p in parts]).astype(np.uint64)
        bucket = np.concatenate([p[0] for p in parts]) % np.uint64(BUCKETS)
        both = np.unique(where * np.uint64(BUCKETS) + bucket)
        offsets = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) * np.uint64(BUCKETS))
        yield run.first, (both % np.uint64(BUCKETS)).astype(np.int32), offsets


class NbSvm:
    def __init__(self) -> None:
        self.weights, self.bias, self.slope, self.shift = np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0

    def decide(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The decision value, by the square root of the number of indicators, so that long texts don't dominate."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(1, np.diff(offsets))) + self.bias

    def scores(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decide(buckets, offsets) + self.shift, -30, 30)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, spare: np.ndarray, seed: int = 11) -> NbSvm:
        train = np.flatnonzero(~spare)
        if len(set(y[train].tolist())) < 2:
            return self
        counts = np.full((2, BUCKETS), ALPHA)
        for i in train:
            counts[y[i], docs[i]] += 1
        p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
        ratio = np.log(p / q)
        ratio[counts.sum(0) - 2 * ALPHA < 2] = 0  # seen in one document: says nothing of others
        w, bias = np.zeros(BUCKETS), 0.0
        sign = np.where(y == 1, 1.0, -1.0)
        share = np.bincount(y[train], minlength=2)
        cost = COST * len(train) / (2 * np.maximum(1, share))
        x = {i: ratio[docs[i]] / np.sqrt(max(1, len(docs[i]))) for i in train}
        square = {i: float(v @ v) + 1.0 for i, v in x.items()}
        alpha = dict.fromkeys(train.tolist(), 0.0)
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(train).tolist():
                g = sign[i] * (w[docs[i]] @ x[i] + bias) - 1
                new = min(max(alpha[i] - g / square[i], 0.0), cost[y[i]])
                if new != alpha[i]:
                    step = (new - alpha[i]) * sign[i]
                    w[docs[i]] += step * x[i]
                    bias += step
                    alpha[i] = new
        self.weights, self.bias = (w * ratio).astype(np.float32), bias
        held = np.flatnonzero(spare) if spare.any() else train
        self._calibrate(np.concatenate([self.decide(docs[i], np.array([0, len(docs[i])])) for i in held]), y[held])
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """A logistic curve by Newton's method, the classes having equal weight."""
        n = np.bincount(y, minlength=2)
        if not n.all():
            return
        weight, target = len(y) / (2 * n[y]), np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
            hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(g * z).sum() + 1e-3 * a, g.sum() + 1e-3 * b]))
            a, b = a - step[0], b - step[1]
        if a > 0:
            self.slope, self.shift = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES) -> NbSvm:
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [b[x:y].tobytes() for _, b, o in indicators(batch.column("text").to_pylist()) for x, y in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(f, pa.binary())], schema=schema)

    sample = labelled_sample(docs, labels, label, {1: max_each, 0: max_each}, FOLDS, HELD_OUT)
    got = bounded_features(sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f binary"), max_bytes)
    ids, y, f = got.column("doc_id").to_numpy(), got.column("y").to_numpy().astype(np.int64), got.column("f")
    order = np.argsort(ids, kind="stable")
    if not len(order):
        return NbSvm()
    x = [np.frombuffer(f[int(i)].as_py(), np.int32) for i in order]
    return NbSvm().fit(x, y[order], (ids[order] * 2654435761 >> 7) % 5 == 0)


def score(docs: DataFrame, model: NbSvm) -> DataFrame:
    """doc_id and score. docs: doc_id, text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [held.value.scores(b, o) for _, b, o in indicators(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
