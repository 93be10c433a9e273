"""Language identification by mixture inference.

Each language has a distribution over hashed byte trigrams (ASCII lower case; any white space is a
space). The words of a document are draws from a mixture of languages: expectation-maximisation
estimates the proportions from the words' n-gram likelihoods. The set of languages is the one with
the best penalised likelihood among the nested sets in order of their proportions. The prediction
is the largest proportion of that set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, fold

#: Training documents of each language, at most: a hashed share of them by id.
FIT_DOCUMENTS = 1_500
#: Languages that are learnt, at most: the most frequent values of `lang`.
LANGUAGES = 256
#: Tasks that count the sample's n-grams.
FIT_TASKS = 8
BUCKETS = 1 << 15
SMOOTH = 0.5
STEPS = 8
#: A further language must raise the log-likelihood by this times log(words).
PENALTY = 2.0
UNKNOWN = "und"

FOLD_BYTE = np.arange(256, dtype=np.uint8)
FOLD_BYTE[list(range(0x41, 0x5B))] += 32
FOLD_BYTE[[*range(0x09, 0x0E), *range(0x30, 0x3A)]] = 0x20
_letter = regex.compile(r"\p{L}").search
_common_letter = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    return bool(_common_letter(text)) or bool(_letter(text.decode()))


def trigrams(buf: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes around each place; beyond the ends stands a space."""
    b = np.full(len(buf) + 2, 0x20, np.uint32)
    b[1:-1] = FOLD_BYTE[buf]
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def fit_tables(docs: DataFrame, folds: int = 4, held_out: int = 2) -> tuple[list[str], np.ndarray]:
    """The languages in order and the (bucket, language) log-probabilities. A language's sample is
    counted in one task, so that the driver gets one vector for each of LANGUAGES at most."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    number = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(FIT_DOCUMENTS)) / F.col("count"))
    # LANGUAGES rows at most
    some = known.join(F.broadcast(number.select("lang", share.alias("share"))), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch, texts in batches(it):
            for lang, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(trigrams(np.frombuffer(t, np.uint8)), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["lang", "counts"])

    rows = some.select("lang", "text").repartition(FIT_TASKS, "lang").mapInArrow(run, "lang string, counts binary").collect()
    total: dict[str, np.ndarray] = {}
    for lang, counts in rows:
        total[lang] = total.get(lang, 0) + np.frombuffer(counts, np.int64)
    names = sorted(total)
    p = np.stack([total[n] + SMOOTH for n in names], axis=1) if names else np.ones((BUCKETS, 0))
    return names, np.log(p / p.sum(axis=0)).astype(np.float32)


def proportions(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once. like: (words, languages), scaled by each word's best;
    first: each document's first word (and the end), none empty; allowed: (documents, languages).
    Returns the proportions and each document's log-likelihood under them."""
    number = np.diff(first)
    part = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        share = like * np.repeat(part, number, axis=0)
        share /= share.sum(axis=1, keepdims=True) + 1e-30
        part = np.add.reduceat(share, first[:-1], axis=0) / number[:, None]
    mixed = (like * np.repeat(part, number, axis=0)).sum(axis=1)
    return part, np.add.reduceat(np.log(mixed + 1e-30), first[:-1])


def infer(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest language (index), its proportion and the size of the chosen set for each text; -1
    where a text has no words."""
    k = table.shape[1]
    best, score, chosen = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), int)
    words = Words(texts)
    number = np.diff(words.first)
    some = np.flatnonzero(number > 0)
    if not len(some) or not k:
        return best, score, chosen
    sums = np.add.reduceat(table[trigrams(words.buf)], words.start, axis=0)
    sums -= sums.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(sums, -30))
    first = np.concatenate(([0], np.cumsum(number[some])))
    single = np.add.reduceat(np.log(like), first[:-1], axis=0)
    part, full = proportions(like, first, np.ones((len(some), k)))
    rank = np.argsort(-part, axis=1, kind="stable")
    price = PENALTY * np.log(number[some] + 1)
    top = single.argmax(axis=1)
    value, final, final_part, final_size = single.max(axis=1), top.copy(), np.take_along_axis(part, top[:, None], 1)[:, 0], np.ones(len(some), int)
    # no set can beat the full one's likelihood: most documents stop here with one language
    open_ = np.flatnonzero(full - price > value)
    for size in range(2, k + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, rank[open_, :size], 1.0, axis=1)
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in open_])
        sub = np.concatenate(([0], np.cumsum(np.diff(first)[open_])))
        p, ll = proportions(like[rows], sub, allowed)
        gain = ll - price[open_] * (size - 1)
        better = gain > value[open_]
        at = open_[better]
        value[at], final[at], final_part[at], final_size[at] = gain[better], p[better].argmax(axis=1), p[better].max(axis=1), size
        open_ = open_[full[open_] - price[open_] * size > value[open_]]
    best[some], score[some], chosen[some] = final, np.clip(final_part, 0, 1), final_size
    return best, score, chosen


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_langs) for each row of ``docs``.

    Learns from ``text`` and the LANGUAGES most frequent values of ``lang`` outside the held-out fold. Null texts and texts
    without a letter are ``und`` with score 0, as is everything when nothing could be learnt.
    """
    names, table = fit_tables(docs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            best, score, size = infer(texts, table)
            known = [b >= 0 and has_letter(t) for b, t in zip(best, texts, strict=True)]
            lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(np.where(known, size, 0), pa.int32())],
                names=["doc_id", "lang_pred", "score", "n_langs"],
            )

    said = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")
    return said.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")
