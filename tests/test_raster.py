"""Labelling by runs, change polygons and coverage against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from labelyard.operators import raster


def plain_components(pixels):
    """{id: smallest id reachable} of {(row, col): id} by 4-neighbourhood."""
    out = {}
    for start in sorted(pixels, key=pixels.get):
        if pixels[start] in out:
            continue
        todo, own = [start], {start}
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in pixels and n not in own:
                    own.add(n)
                    todo.append(n)
        out |= {pixels[p]: pixels[start] for p in own}
    return out


def grid(rng, rows, cols, share):
    ids = list(range(rows * cols))
    rng.shuffle(ids)
    return {(r, c): ids[r * cols + c] for r in range(rows) for c in range(cols) if rng.random() < share}


@pytest.mark.parametrize("block", [256, 5])
@pytest.mark.parametrize("share", [0.35, 0.6, 0.9])
def test_components_by_runs(spark, monkeypatch, block, share):
    monkeypatch.setattr(raster, "BLOCK", block)
    rng = random.Random(block + int(share * 10))
    tiles = {t: grid(rng, 23, 17, share) for t in ("a", "b")}
    rows = [(i + (10_000 if t == "b" else 0), t, r, c) for t, px in tiles.items() for (r, c), i in px.items()]
    mask = spark.createDataFrame(rows, "id long, tile string, row long, col long")
    want = plain_components(tiles["a"]) | {i + 10_000: c + 10_000 for i, c in plain_components(tiles["b"]).items()}
    assert {r["id"]: r["component"] for r in raster.components(mask).collect()} == want
    assert raster.components(mask.limit(0)).count() == 0


def shapes(spark, pictures):
    rows = [(t * 10_000 + r * 100 + c, t, r, c, k) for t, (picture, k) in enumerate(pictures) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "id long, tile long, row long, col long, component long")


def test_rings_of_known_shapes(spark):
    pictures = [(["####", "#..#", "#..#", "####"], 1), (["##.", "##.", "..#"], 2), (["#"], 3), (["##.##", "#####"], 4), (["###", "#.#", "##.", "###"], 5)]
    edges = raster.boundary(shapes(spark, pictures))
    sizes = {r["component"]: r for r in raster.measures(edges, 10.0).collect()}
    assert {k: (r["area"], r["length"]) for k, r in sizes.items()} == {1: (1200.0, 240.0), 2: (500.0, 120.0), 3: (100.0, 40.0), 4: (900.0, 160.0), 5: (1000.0, 200.0)}
    rings = {}
    for r in raster.polygons(edges).collect():
        rings.setdefault(r["component"], []).append((r["hole"], [tuple(p) for p in r["ring"]], r["twice_area"]))
    assert sorted(rings[1]) == [(False, [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], 32), (True, [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], -8)]
    assert rings[3] == [(False, [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], 2)]
    # pixels that touch at a corner only are outlines of their own
    assert sorted(t for _, _, t in rings[2]) == [2, 8]
    for k, own in rings.items():
        assert sum(t for _, _, t in own) * 50 == sizes[k]["area"]
        assert all(ring[0] == ring[-1] for _, ring, _ in own)


def test_rings_of_random_components_have_the_sums(spark):
    rng = random.Random(12)
    px = grid(rng, 30, 30, 0.62)
    comp = plain_components(px)
    rows = [(i, 0, r, c, comp[i]) for (r, c), i in px.items()]
    edges = raster.boundary(spark.createDataFrame(rows, "id long, tile long, row long, col long, component long"))
    n = {k: sum(c == k for c in comp.values()) for k in set(comp.values())}
    assert {r["component"]: r["area"] for r in raster.measures(edges, 1.0).collect()} == {k: float(v) for k, v in n.items()}
    twice = {}
    for r in raster.polygons(edges).collect():
        twice.setdefault(r["component"], []).append((r["hole"], r["twice_area"]))
        points = [tuple(p) for p in r["ring"]]
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(points, points[1:], strict=False))
        assert all(((a[0] == b[0]) != (b[0] == c[0])) for a, b, c in zip(points, points[1:], points[2:], strict=False))
    for k, own in twice.items():
        assert sum(t for _, t in own) == 2 * n[k] and sum(not hole for hole, _ in own) == 1


def test_changes_need_coverage_and_area(spark):
    rows = []
    for tile in range(4):
        for r in range(10):
            for c in range(10):
                before = None if (tile == 0 and c < 6) or (tile == 1 and c >= 6) else 0.0
                rows.append((tile * 1000 + r * 10 + c, tile, r, c, before, 1.0 if r < 2 and (tile != 3 or c < 2) else 0.0))
    table = spark.createDataFrame(rows, "id long, tile long, row long, col long, before double, after double")
    found, edges = raster.change_polygons(table, F.col("before"), F.col("after"), 0.5, 10.0)
    got = {r["tile"]: tuple(r)[2:] for r in found.collect()}
    # tile 0 has too few values, tile 1 few; the change of tile 3 is below 500 square metres
    assert got == {1: ("gain", 12, 16, 1200.0, 160.0, "low_quality"), 2: ("gain", 20, 24, 2000.0, 240.0, "normal")}
    assert {r["component"] for r in edges.collect()} == {1000, 2000}
    none, _ = raster.change_polygons(table.limit(0), F.col("before"), F.col("after"), 0.5, 10.0)
    assert none.count() == 0
