"""Periodic runs of words: stretches that repeat a block of words at least three times.

``find`` builds the suffix automaton of a word sequence and then goes through its words in order.
Each word's access in the tree of suffix links gives the whole path of its prefix the colour of the
word's place, so a colour is the last place at which the path's strings ended. The path falls into
segments of one colour. Where the distance d between a segment's old end and the new one is no
longer than the segment's longest string, that string stands twice with d between, which is a
stretch of period d that contains a square; its left end is exact, as the longest common suffix of
two prefixes is the deepest string that has ended at both. The next words extend it. The paths are
kept as in link-cut trees: splay trees by depth, one for each segment, with its colour at the root.

Most words are in no run, so ``stretches`` first keeps what can be one, for many texts at once: all
words of a run with at least LEAST words and TIMES periods lie in GRAM-grams that come again within
a third of the stretch. This can't lose a run, for any input; what it keeps goes to ``find``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, Words, batches, mix

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: With grams of 8 words each gram of such a run comes again one period earlier or later in it.
GRAM = 8
#: Rounds of the screen at most; each only takes away what can't be a run.
ROUNDS = 8

Run = tuple[int, int, int]
Change = Callable[[object, list[bytes]], list[bytes]]


def find(words: list, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs (start, length, period), by start and then period, of hashable words. Periods are
    the smallest ones, and no neighbouring word extends a run."""
    after: list[dict] = [{}]
    link, size, ends, last = [-1], [0], [], 0
    for w in words:
        new = len(size)
        after.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = new
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                after.append(after[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        ends.append(new)
    del after

    # the empty string's state is left out: it is longer than no distance
    up = [p if p > 0 else -1 for p in link]
    left, right, colour = [-1] * len(up), [-1] * len(up), [0] * len(up)

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    found: dict[tuple[int, int], int] = {}
    for end, state in enumerate(ends, 1):
        below, x = -1, state
        while x >= 0:
            while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
                g = up[p]
                if g >= 0 and (left[g] == p or right[g] == p):
                    rotate(p if (left[g] == p) == (left[p] == x) else x)
                    colour[x] = colour[g]
                else:
                    colour[x] = colour[p]
                rotate(x)
            before = colour[x]
            if before:
                period = end - before
                length = size[x] + period
                if period <= size[x] and length >= least and length >= times * period:
                    found[end - length, period] = end
            if right[x] >= 0:
                colour[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
    return sorted((start, end - start, period) for (start, period), end in found.items())


def stretches(words: Words) -> np.ndarray:
    """(first word, words) of the stretches that can hold runs, as words of the whole batch. A
    stretch lies within one text."""
    none, n = np.zeros((0, 2), np.int64), len(words.hashes)
    if n < LEAST:
        return none
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    grams = text[: n - GRAM + 1].astype(np.uint64) * GOLD
    for i in range(GRAM):
        grams = mix(grams + words.hashes[i : n - GRAM + 1 + i])
    at = np.flatnonzero(text[: n - GRAM + 1] == text[GRAM - 1 :])
    order = at[np.argsort(grams[at])]
    same = grams[order[1:]] == grams[order[:-1]]
    at = np.sort(order[np.append(same, False) | np.insert(same, 0, False)])
    order = at[np.argsort(grams[at], kind="stable")]
    gap = np.where(grams[order[1:]] == grams[order[:-1]], np.diff(order), n)
    near = np.empty(len(order), np.int64)
    near[np.searchsorted(at, order)] = np.minimum(np.append(gap, n), np.insert(gap, 0, n))[: len(order)]
    for _ in range(ROUNDS):
        if not len(at):
            return none
        edge = np.flatnonzero(np.diff(at) != 1) + 1
        first, size = np.insert(edge, 0, 0), np.diff(np.concatenate(([0], edge, [len(at)])))
        long = np.repeat(size, size) + GRAM - 1
        keep = (near * TIMES <= long) & (long >= LEAST)
        if keep.all():
            break
        at, near = at[keep], near[keep]
    else:
        edge = np.flatnonzero(np.diff(at) != 1) + 1
        first, size = np.insert(edge, 0, 0), np.diff(np.concatenate(([0], edge, [len(at)])))
    return np.stack((at[first], size + GRAM - 1), 1) if len(at) else none


def runs_of(texts: list[bytes]) -> list[list[Run]]:
    """Each text's runs, by start and then period."""
    words, out = Words(texts), [[] for _ in texts]
    for start, size in stretches(words).tolist():
        i = int(np.searchsorted(words.first, start, side="right")) - 1
        known: dict[bytes, int] = {}
        said = [known.setdefault(words.buf[a:b].tobytes(), len(known)) for a, b in zip(words.start[start : start + size], words.stop[start : start + size], strict=True)]
        out[i] += [(int(start - words.first[i]) + a, length, period) for a, length, period in find(said)]
    return [sorted(r) for r in out]


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Of n words, those that lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def greatest(runs: list[Run]) -> Run:
    """The run with the greatest length / period; of equals the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:  # these come later in that order
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def plant(doc_id: object, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents with a repeated tail; a document without an id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def _words(batch: pa.RecordBatch, texts: list[bytes], change: Change | None) -> list[list[bytes]]:
    words = [t.split() for t in texts]  # bytes are split at just these six white space characters
    return words if change is None else [change(i, w) for i, w in zip(batch.column(0).to_pylist(), words, strict=True)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): one row for each run of each document, in words from 0.

    Null and empty texts have none; repeated rows give repeated rows; an empty table gives none.
    Other columns don't matter. Texts stay in the task that reads them.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            ids = batch.column(0).to_pylist()
            rows = [(i, *r) for i, runs in zip(ids, runs_of(texts), strict=True) for r in runs]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "length", "period"), r, strict=True)) for r in rows], pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run cut to its first period and words joined by one space, for texts with
    a run; other texts stay as they are, null included. All columns and rows are kept."""
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            at = names.index("text")
            said = batch.column(at).to_pylist()
            for i, runs in enumerate(runs_of(texts)):
                if runs:
                    words = texts[i].split()
                    said[i] = b" ".join(w for w, gone in zip(words, dropped(runs, len(words)).tolist(), strict=True) if not gone).decode()
            yield batch.set_column(at, names[at], pa.array(said, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


DIGESTS = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def digests(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """One row for each document: its number of runs, the run of the greatest exponent (nulls
    without one), and digests of all runs and of the collapsed words. ``change`` gets each id and
    its words and returns the words to take. Defined for awkward rows as ``periodic_runs``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            words = _words(batch, texts, change)
            texts = [b" ".join(w) for w in words]
            cols: list[list] = [[] for _ in DIGESTS]
            for i, text, own, runs in zip(batch.column(0).to_pylist(), texts, words, runs_of(texts), strict=True):
                best = greatest(runs) if runs else (None, None, None)
                if runs:
                    text = b" ".join(w for w, gone in zip(own, dropped(runs, len(own)).tolist(), strict=True) if not gone)
                said = "".join("%d,%d,%d\n" % r for r in runs).encode()
                row = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest())
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, DIGESTS.values(), strict=True)], names=list(DIGESTS))

    schema = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in DIGESTS.items())
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def brute(words: list, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs by comparing words at every distance, for tests."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())
