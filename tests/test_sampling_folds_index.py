"""Sampling with replacement, exact group folds and the exact cell index against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelyard.operators import folds, sampling, similarity

# sampling


def test_equal_weights_give_multinomial_counts(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit(0.1).alias("w"))
    hits = Counter(r["k"] for r in sampling.weighted_sample(rows, "k", "w").collect())
    assert sum(hits.values()) == n
    counts = np.array([hits[i] for i in range(n)])
    # a draw with replacement leaves about n / e rows out; the counts' mean and variance are about 1
    assert abs((counts == 0).mean() - math.exp(-1)) < 0.01
    assert abs(counts.var() - 1) < 0.05 and abs((counts == 2).mean() - math.exp(-1) / 2) < 0.01


def test_counts_follow_the_weights(spark):
    weights = {"a": 1.0, "b": 3.0, "c": 0.0, "d": None, "e": float("nan"), "f": -2.0, "g": 4.0}
    rows = spark.createDataFrame(list(weights.items()), "k string, w double")
    hits = Counter(r["k"] for r in sampling.weighted_sample(rows, "k", "w", draws=16_000, seed=7).collect())
    assert set(hits) == {"a", "b", "g"} and sum(hits.values()) == 16_000
    for k in hits:
        p = weights[k] / 8
        assert abs(hits[k] - 16_000 * p) < 4 * math.sqrt(16_000 * p * (1 - p))


def test_draws_match_the_plain_line(spark):
    """Each draw hits the row whose stretch holds its point, in any number of partitions."""
    import hashlib

    rng = random.Random(3)
    some = [(f"k{i:03}", rng.choice([0.0, 0.5, 1.0, 2.5, 90.0])) for i in range(200)]
    top = max(w for _, w in some)
    ends, total = [], 0
    for k, w in sorted(some):
        if w > 0:
            total += max(1, round(w / top * sampling.STEPS))
            ends.append((total, k))
    want = {}
    for i in range(500):
        h = hashlib.md5(f"42:{i}".encode()).hexdigest()
        point = (int(h[:15], 16) * (1 << 60) + int(h[15:30], 16)) % total
        want[i] = next(k for end, k in ends if point < end)
    for parts in (1, 9):
        rows = spark.createDataFrame(some, "k string, w double").repartition(parts)
        assert {r["draw"]: r["k"] for r in sampling.weighted_sample(rows, "k", "w", draws=500).collect()} == want


def test_draws_from_nothing(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", None)], "k string, w double")
    assert sampling.weighted_sample(rows, "k", "w").count() == 0
    assert sampling.weighted_sample(rows.limit(0), "k", "w", draws=5).count() == 0


# folds


def plain_folds(groups, k, labels):
    """Groups one by one, largest spread first, by sums of all rows."""
    totals = [max(sum(g[c] for g in groups.values()), 1) for c in range(labels)]

    def spread(g):
        s = [x / t for x, t in zip(g, totals, strict=True)]
        mean = sum(s) / labels
        return round(math.sqrt(sum((x - mean) ** 2 for x in s) / labels), 9)

    held, out = [[0] * labels for _ in range(k)], {}
    for name, g in sorted(groups.items(), key=lambda x: (-spread(x[1]), x[1])):

        def cost(f):
            total = 0.0
            for c in range(labels):
                s = [h[c] + (g[c] if i == f else 0) for i, h in enumerate(held)]
                total += math.sqrt(k * sum(x * x for x in s) - sum(s) ** 2) / totals[c]
            return round(total, 12), sum(held[f]), f

        best = min(range(k), key=cost)
        held[best] = [x + y for x, y in zip(held[best], g, strict=True)]
        out[name] = best
    return out, held


def dealt(spark, groups, k, labels):
    rows = spark.createDataFrame([(name, c, n) for name, g in groups.items() for c, n in enumerate(g) if n], "g string, y int, n int")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    found = {r["g"]: r["fold"] for r in folds.group_folds(rows, "g", "y", labels, folds=k).collect()}
    assert set(found) == set(groups)
    return found


def held_by(found, groups, k, labels):
    return [[sum(groups[n][c] for n, f in found.items() if f == i) for c in range(labels)] for i in range(k)]


def test_folds_equal_a_plain_greedy(spark):
    rng = random.Random(11)
    groups = {f"g{i}": [rng.choice([0, 0, 0, 1, 2, 7]), rng.choice([0, 1]), rng.choice([0, 0, 3])] for i in range(700)}
    groups = {n: g for n, g in groups.items() if sum(g)} | {"huge": [900, 0, 0], "big": [0, 130, 40]}
    found = dealt(spark, groups, 4, 3)
    want, held = plain_folds(groups, 4, 3)
    assert held_by(found, groups, 4, 3) == held
    # equal groups are alike: each fold gets as many of a kind
    kinds = lambda of: Counter((tuple(groups[n]), f) for n, f in of.items())
    assert kinds(found) == kinds(want)


def test_folds_of_many_equal_groups_equal_a_plain_greedy():
    """50,000 groups of few kinds; the cycle gives what dealing each would."""
    rng = random.Random(5)
    kinds = [((40, 0), 3), ((0, 9), 5), ((2, 1), 11_001), ((1, 0), 30_002), ((0, 1), 9_003)]
    groups = {f"{k}-{i}": list(v) for k, (v, n) in enumerate(kinds) for i in range(n)}
    _, held = plain_folds(groups, 4, 2)
    totals = [sum(v[c] * n for v, n in kinds) for c in range(2)]
    spread = lambda v: round(math.sqrt(sum((v[c] / totals[c] - sum(v[i] / totals[i] for i in range(2)) / 2) ** 2 for c in range(2)) / 2), 9)
    dealer, counts = folds.Dealer(4, totals), [[0, 0] for _ in range(4)]
    for v, n in sorted(kinds, key=lambda x: (-spread(x[0]), x[0])):
        first, cycle = dealer.deal(list(v), n)
        assert len(first) < 200
        for i in range(n):
            f = first[i] if i < len(first) else cycle[(i - len(first)) % len(cycle)]
            counts[f] = [x + y for x, y in zip(counts[f], v, strict=True)]
    assert counts == held and rng is not None


def test_folds_of_null_groups_and_too_few(spark):
    rows = spark.createDataFrame([(None, 0), (None, 1), ("a", 0), ("b", 1), ("c", 5)], "g string, y int")
    found = {r["g"]: r["fold"] for r in folds.group_folds(rows, "g", "y", 2).collect()}
    assert set(found) == {None, "a", "b", "c"}
    with pytest.raises(ValueError):
        folds.group_folds(rows.limit(0), "g", "y", 2)


# the index


def clustered(rng, n, centres, spread):
    c = rng.normal(size=(centres, 24))
    return c[rng.integers(centres, size=n)] + rng.normal(size=(n, 24)) * spread


def vectors(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")


def same_rows(found, want):
    key = lambda df: sorted((r["query_id"], r["rank"], r["base_id"], round(r["cosine"], 6)) for r in df.collect())
    assert key(found) == key(want)


@pytest.mark.parametrize("block", [4096, 70])
def test_index_finds_the_same_and_compares_few(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(4)
    v = clustered(rng, 1300, 20, 0.05)
    queries, base = vectors(spark, v[:100]), vectors(spark, v[100:], 1000)
    index = similarity.CellIndex(base, cells=20)
    found, compared = index.search(queries, 5)
    same_rows(found, similarity.cosine_topk(queries, base, 5))
    pairs = compared.collect()
    assert len(pairs) == len({(r["id"], r["cell"]) for r in pairs})
    share = sum(int(index.size[r["cell"]]) for r in pairs) / (100 * 1200)
    assert share < 0.25


def test_index_is_exact_without_clusters(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate((rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0), np.zeros((2, 8))))
    queries, base = vectors(spark, v[::4]), vectors(spark, v, 1000)
    for k in (1, 7, 500):
        found, _ = similarity.CellIndex(base, cells=12).search(queries, k)
        same_rows(found, similarity.cosine_topk(queries, base, k))


def test_index_of_nothing_and_nulls(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vec array<double>")
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "id long, vec array<double>")
    found, _ = similarity.CellIndex(base).search(asked, 3)
    assert [(r["query_id"], r["base_id"], r["rank"]) for r in found.collect()] == [(7, 1, 1)]
    none, _ = similarity.CellIndex(base.limit(0)).search(asked, 3)
    assert none.count() == 0
    assert similarity.CellIndex(base).search(asked.limit(0), 3)[0].count() == 0
