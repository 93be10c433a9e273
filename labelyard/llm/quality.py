"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over whole texts. Trees are complete to a fixed
depth, so a forest is three rectangular arrays (feature, threshold, leaf) and all documents walk
all trees at once with array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, fold, kept_rows, labelled, sigmoid

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.12, 2.0, 8
ACCEPT = 0.7

CLASSES = ("upper", "lower", "digit", "symbol", "bang", "stop", "comma", "line", "space", "high", "other")
FEATURES = ("log_words", "word_bytes", "upper", "digit", "symbol", "bang", "stop", "comma", "line", "high", "other", "distinct", "repeat_next", "long_words", "one_byte_words", "top_share", "log_bytes")


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("digit", b"0123456789"), ("symbol", b"#*$%&|<>"), ("bang", b"!"), ("stop", b"."), ("comma", b","), ("line", b"\n"), ("space", b" \t\r\f\v"), ("high", bytes(range(128, 256)))):
        table[list(chars)] = CLASSES.index(name)
    return table


CLASS = _class_table()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text gives zeros."""
    words = Words(texts)
    n = len(texts)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(n), size + 1)
    counts = np.bincount(owner * len(CLASSES) + CLASS[words.buf], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    counts[:, CLASSES.index("space")] -= 1  # the separator
    kind = {c: counts[:, i] for i, c in enumerate(CLASSES)}
    h, first = words.hashes, words.first
    length = words.stop - words.start
    number = np.diff(first)
    many = np.maximum(number, 1)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(x)))[first])

    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][number > 0]] = False
    distinct, top = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
            distinct[i], top[i] = len(runs), runs.max()
    letters = np.maximum(kind["upper"] + kind["lower"] + kind["high"], 1)
    size = np.maximum(size, 1)
    out = np.stack([
        np.log1p(number), per_text(length) / many, kind["upper"] / letters, kind["digit"] / size, kind["symbol"] / size, kind["bang"] / many, kind["stop"] / many, kind["comma"] / many, kind["line"] / many, kind["high"] / letters, kind["other"] / size,
        distinct / many, per_text(again) / many, per_text(length >= 16) / many, per_text(length == 1) / many, top / many, np.log1p(size) * (number > 0),
    ], axis=1)
    return out.astype(np.float32)


class Forest:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def __call__(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), sigmoid(np.float64(self.base)))
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return sigmoid(self.base + self.leaf[tree, node - inner].sum(axis=1))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss. Without both labels: a constant score."""
    inner, none = 2**DEPTH - 1, np.zeros((0, 2**DEPTH - 1))
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Forest(base, none.astype(int), none, np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    feature, threshold, leaf = (np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1)))
    score = np.full(len(y), base)
    for t in range(TREES):
        p = sigmoid(score)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            wide = 2**level
            local = node - (wide - 1)
            best = np.zeros(wide)
            for f, b in enumerate(binned):
                key = local * BINS + b
                shape = (wide, BINS)
                gs, hs, ns = (np.bincount(key, w, wide * BINS).reshape(shape).cumsum(axis=1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE)
                gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS)] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(wide), at] > best + 1e-9):
                    if at[k] < len(cuts[f]):
                        best[k] = gain[k, at[k]]
                        feature[t, wide - 1 + k], threshold[t, wide - 1 + k] = f, cuts[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        local = node - inner
        leaf[t] = RATE * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + RIDGE)
        score += leaf[t][local]
    return Forest(base, feature, threshold, leaf)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) for each row of ``docs``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            x = statistics(texts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Forest:
    """A forest from labelled rows outside the held-out fold, FIT_ROWS of them at most. Only their
    texts are read for it; of rows with the same id one counts."""
    known = labelled(labels, "quality").filter(fold("doc_id", folds) != held_out)
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id"), "doc_id", "left_semi")
    some = document_statistics(rows).groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id").toPandas().sort_values("doc_id")
    x = np.array(some["x"].tolist(), np.float32).reshape(len(some), len(FEATURES))
    return fit(x, some["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null texts count as empty; an empty text has a score too. Equal texts have equal scores. With
    no usable labels every score is the same. Held out is false for a null id.
    """
    forest = learn(docs, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest(statistics(texts)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` predicts 1 for."""
    forest = learn(docs, labels)
    return kept_rows(docs, lambda: lambda texts: forest(statistics(texts)) >= ACCEPT)
