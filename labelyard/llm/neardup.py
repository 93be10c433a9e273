"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct ``width``-word shingles (64-bit hashes; ASCII lower case). Two
fixed permutations of a universe of 2**20 points make the whole signature: the first scatters
the shingles, the second, shifted circularly by k, gives coordinate k as its minimum. Bands of
coordinates are bucket keys.

Documents with equal sets form a class and one of them stands for it from then on. Links are
found in two rounds and confirmed on full sets:

1. in each bucket every class is compared with the bucket's smallest class;
2. in buckets that still hold several components, all classes are put to an exact prefix join:
   with shingles in order of frequency among these classes, two sets of that similarity share one
   near the front of both. Only rows of different components meet at a shingle, and pairs whose
   positions rule the similarity out are dropped, so no link is lost and the many pairs within a
   group of copies are never made. A passage that many documents share is far back in their
   orders, unless it makes up about the threshold's share of both.

Keys that many rows have (a bucket, a shingle, a document with many partners, a digest) are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.hot import join_split, key_counts
from .common import GOLD, Words, batches, cut, mix

WIDTH = 5
THRESHOLD = 75
BANDS, ROWS = 40, 5
UNIVERSE = 1 << 20
#: Rows of one token, on either side, that meet in one group of the prefix join.
PART = 1000
SEED = 7

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


class Circulant:
    """The two permutations, and signatures from them."""

    def __init__(self, coordinates: int):
        rng = np.random.default_rng(SEED)
        self.scatter = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = rng.permutation(UNIVERSE).astype(np.uint32)
        # row i: the second permutation at i, i+1, ..., wrapping round
        self.shifted = sliding_window_view(np.concatenate((ring, ring[: coordinates - 1])), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles >> np.uint64(44)).astype(np.int64)]
        out = self.shifted[at[:2048]].min(axis=0)
        for i in range(2048, len(at), 2048):
            np.minimum(out, self.shifted[at[i : i + 2048]].min(axis=0), out=out)
        return out


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than ``width``: the whole sequence
    is one shingle; no words: an empty set."""
    words = Words([t.lower() for t in texts])
    h = words.hashes
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
    for j in range(width):
        rolled += h[j : n + j] * factor[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(x) * int(f) for x, f in zip(h[a:b], factor, strict=False)) + (b - a) & 2**64 - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys). Empty sets have neither."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        factor = mix(np.arange(1, rows + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) * GOLD
        for batch, texts in batches(it):
            sets = shingle_sets(texts, width)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = [mix((circulant.signature(s).astype(np.uint64).reshape(bands, rows) * factor).sum(axis=1) + salt).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles array<long>)"""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(texts, width)], pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * |A and B| >= threshold * |A or B|, on full sets. A
    document with many partners is split, so that their sets don't meet in one task."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - both
    with_sets = join_split(join_split(pairs, right, "b", by="a"), left, "a", by="b", counts=key_counts(pairs, "a"))
    return cut(with_sets.filter(100 * both >= threshold * total).select("a", "b").distinct())


def prefixes(placed: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, component, n, token, i, short) of the tokens that come first in each set, in the
    order of how many sets have them. placed: (doc_id, component).

    All common tokens of two sets come at or behind their first one, whose place i in a set of n
    bounds the overlap by n - i. Two similar sets overlap by the share t of the longer and by
    2t / (1 + t) of the shorter: tokens with room for the first are kept, and ``short`` says of
    those with room for the second, too. A token of one set only takes a place but has no row.
    """
    own = sets.join(placed, "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), "shingles")
    tokens = own.select("doc_id", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = join_split(tokens, often, "token", by="doc_id", counts=often.withColumnRenamed("often", "n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("order"))
    rows = own.select("doc_id", "component", "n").join(shared, "doc_id")
    rows = rows.select("doc_id", "component", "n", (F.col("n") - F.size("order")).alias("alone"), F.posexplode("order").alias("at", "t"))
    rows = rows.select("doc_id", "component", "n", F.col("t.token").alias("token"), (F.col("alone") + F.col("at")).alias("i"))
    room = F.col("n") - F.col("i")
    return rows.filter(100 * room >= threshold * F.col("n")).withColumn("short", (100 + threshold) * room >= 2 * threshold * F.col("n"))


def meetings(rows: DataFrame) -> DataFrame:
    """Rows of ``prefixes`` that have a token in common, in columns of x (short) and of y; of
    different components, or of the same in fewer cases.

    Tokens of one component are left out first. Of a token's components the largest meets only the
    others: an x outside it meets every y, an x inside it every y outside. So there are at most
    twice as many rows as pairs of different components. A token with many rows is dealt in parts
    of PART rows of x by PART rows of y.
    """
    of = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.count_if("short").alias("s"))
    most = F.struct("m", "component")
    tokens = of.groupBy("token").agg(F.max_by("component", most).alias("large"), F.max_by("m", most).alias("m_in"), F.max_by("s", most).alias("s_in"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    parts = lambda n: F.ceil(n / PART).cast("int")
    out, in_ = F.struct(F.lit(False).alias("large"), parts(F.col("s") - F.col("s_in")).alias("x"), parts(F.col("m")).alias("y")), F.struct(F.lit(True).alias("large"), parts(F.col("s_in")).alias("x"), parts(F.col("m") - F.col("m_in")).alias("y"))
    tokens = cut(tokens.filter("m > m_in and s > 0").select("token", F.col("large").alias("largest"), out.alias("out"), in_.alias("in_")))
    rows = cut(join_split(rows, tokens, "token", by="doc_id"))
    inside = F.col("component") == F.col("largest")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    names = ("doc_id", "component", "n", "i")

    def side(some: DataFrame, k: str, other: str) -> DataFrame:
        """Each row's own part, repeated for all parts of the other side."""
        some = some.filter(F.col("kind.x") * F.col("kind.y") > 0)
        return some.select("token", F.col("kind.large").alias("large"), place(F.col(f"kind.{k}")).alias(k), every(F.col(f"kind.{other}")).alias(other), *[F.col(c).alias(f"{c}_{k}") for c in names])

    x = side(rows.filter("short").withColumn("kind", F.when(inside, F.col("in_")).otherwise(F.col("out"))), "x", "y")
    y = side(rows.withColumn("kind", F.explode(F.when(inside, F.array("out")).otherwise(F.array("out", "in_")))), "y", "x")
    return x.join(y, ["token", "large", "x", "y"])


def prefix_pairs(placed: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b, of different components that may reach the threshold. placed: (doc_id,
    component). The first common token of a pair must leave room for the overlap that is needed."""
    met = meetings(cut(prefixes(placed, sets, threshold)))
    room = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    may = (100 + threshold) * room >= threshold * (F.col("n_x") + F.col("n_y"))
    longer = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("doc_id_x") < F.col("doc_id_y")))
    pairs = met.filter(longer & (F.col("component_x") != F.col("component_y")) & may)
    return cut(pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct())


def candidates(classes: DataFrame) -> DataFrame:
    """(key, id, n, pivot, n_pivot): classes of every bucket that has two or more of them; the
    pivot is the smallest, with its size."""
    rows = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("n_pivot"), F.count(F.lit(1)).alias("held")).filter("held > 1"))
    return cut(join_split(rows, shared.select("key", "pivot", "n_pivot"), "key", by="id", counts=shared.select("key", F.col("held").alias("n"))))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null and word-less texts have an empty set and stand alone. Rows with equal sets are always
    linked. Rows with the same id count as one document. A row without an id can't be named by a
    component: its component is null and it is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(sketches(docs, width, bands, rows))
    classes = cut(sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    member = candidates(classes)
    fits = lambda x, y: 100 * F.least(x, y) >= threshold * F.greatest(x, y)

    ids = cut(member.select(F.col("id").alias("doc_id")).distinct())
    sets = cut(full_sets(docs.join(ids, "doc_id", "left_semi"), width))

    stars = cut(member.filter((F.col("id") != F.col("pivot")) & fits(F.col("n"), F.col("n_pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    links = confirmed(stars, sets, threshold)
    first = components(links)

    placed = cut(member.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
    open_ = cut(placed.join(mixed, "key", "left_semi").select(F.col("id").alias("doc_id"), "component").distinct())
    links = links.unionByName(confirmed(prefix_pairs(open_, sets, threshold), sets, threshold))

    found = components(links)
    group = cut(classes.join(found, classes.rep == found.id, "left").select("digest", F.coalesce("component", "rep").alias("component_id")))
    out = join_split(sketch.select("doc_id", "n_shingles", "digest"), group, "digest", by="doc_id", how="left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps. Rows with the same id and text: one."""
    keys = cut(groups.filter("kept and doc_id is not null").select("doc_id").distinct())
    named = docs.filter("doc_id is not null").join(keys, "doc_id", "left_semi").select(*docs.columns)
    text = next(n for n in map("_text{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    named = named.withColumn(text, F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", text]).drop(text)
    return named.unionByName(docs.filter("doc_id is null"))


def brute(rows: list[tuple[int, str | None]], threshold: int = THRESHOLD, width: int = WIDTH) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component) by comparing all pairs, with plain strings; for tests."""
    import re

    sets = {}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
