"""Rasters as pixel tables (tile, row, col, bands)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components as graph_components
from .hot import join_split
from .persist import cut

#: Rows and columns of a block that one task labels.
BLOCK = 256


def misaligned(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = ("crs", "transform", "width", "height")) -> DataFrame:
    """(tile, differs): grid fields in which two descriptions of a tile differ."""
    x, y = (d.select("tile", *[F.col(f).alias(f"{k}_{f}") for f in fields]) for d, k in ((a, "a"), (b, "b")))
    off = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    return x.join(y, "tile", "full").select("tile", F.array_join(off, ",").alias("differs"))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def histogram(rows: DataFrame, tile: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins))).cast("int")
    return rows.filter(F.col(value).isNotNull()).groupBy(tile, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(rows: DataFrame, tile: str, value: str, bins: int = 32, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(tile, threshold_bin): the last bin of the lower class at the largest variance between the
    classes; the first of equals. Windows run over bins, not pixels."""
    h = histogram(rows, tile, value, bins, low, high)
    up, every = Window.partitionBy(tile).orderBy("bin"), Window.partitionBy(tile)
    h = h.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("n", F.sum("n").over(every)).withColumn("s", F.max("s0").over(every))
    n1 = F.col("n") - F.col("n0")
    gap = F.try_divide("s0", "n0") - F.try_divide(F.col("s") - F.col("s0"), n1)
    h = h.withColumn("between", F.round(F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(0.0)), 6))
    return h.groupBy(tile).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold_bin"))


def _label_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds ``label`` to the set pixels of one block: the smallest id of those that hang together in
    it. Pixels that follow each other in a row are a run; runs that touch in neighbouring rows are
    united."""
    rows = rows.sort_values(["row", "col"], ignore_index=True)
    r, c = rows["row"].to_numpy(), rows["col"].to_numpy()
    first = np.flatnonzero(np.append(True, (np.diff(r) != 0) | (np.diff(c) != 1)))
    at, low, high = r[first], c[first], c[np.append(first[1:], len(rows)) - 1]
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = {int(x): i for i, x in reversed(list(enumerate(at)))}
    above = -1
    for i, (x, a, b) in enumerate(zip(at.tolist(), low.tolist(), high.tolist(), strict=True)):
        if i == starts[x]:
            above = starts.get(x - 1, -1)
        while above >= 0 and at[above] == x - 1 and high[above] < a:
            above += 1
        j = above
        while j >= 0 and at[j] == x - 1 and low[j] <= b:
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
            j += 1
    least = np.minimum.reduceat(rows["id"].to_numpy(), first)
    top = np.array([find(i) for i in range(len(root))])
    smallest = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(smallest, top, least)
    size = np.diff(np.append(first, len(rows)))
    return rows.assign(label=np.repeat(smallest[top], size))[["id", "tile", "row", "col", "label"]]


def labelled(mask: DataFrame) -> DataFrame:
    """Set pixels (id, tile, row, col; each place once) with ``label``, the smallest id of their
    component within a block of BLOCK x BLOCK pixels."""
    kind = mask.schema["tile"].dataType.simpleString()
    block = [F.floor(F.col(c) / BLOCK).alias(f"_{c}") for c in ("row", "col")]
    return mask.select("id", "tile", "row", "col", *block).groupBy("tile", "_row", "_col").applyInPandas(lambda rows: _label_block(rows), f"id long, tile {kind}, row long, col long, label long")


def components(mask: DataFrame) -> DataFrame:
    """(id, component) of set pixels (id, tile, row, col) by 4-neighbourhood: the smallest id of the
    component. Blocks are labelled by runs; only pixels at their borders become edges of a graph."""
    rows = cut(labelled(mask))
    meet = []
    for axis, other in (("row", "col"), ("col", "row")):
        place = F.pmod(F.col(axis), F.lit(BLOCK))
        before = rows.filter(place == BLOCK - 1).select("tile", (F.col(axis) + 1).alias(axis), other, F.col("label").alias("a"))
        behind = rows.filter(place == 0).select("tile", axis, other, F.col("label").alias("b"))
        meet.append(before.join(behind, ["tile", axis, other]).select("a", "b"))
    merged = graph_components(meet[0].unionByName(meet[1])).select(F.col("id").alias("label"), "component")
    # blocks hold BLOCK * BLOCK rows at most, so a label has no more
    return rows.join(merged, "label", "left").select("id", F.coalesce("component", "label").alias("component"))


def water_mask(rows: DataFrame, index: Column, threshold: float, least: int) -> DataFrame:
    """(id, water): 1 where the index exceeds the threshold in a component of ``least`` pixels."""
    found = components(rows.filter(index > threshold).select("id", "tile", "row", "col"))
    counts = cut(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    kept = join_split(found, counts.filter(F.col("n") >= least), "component", by="id", counts=counts.select("component", "n")).select("id", F.lit(1).alias("water"))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("water", F.lit(0)).alias("water"))


def coverage(rows: DataFrame, tile: str, valid: Column, low: float = 0.5, normal: float = 0.7) -> DataFrame:
    """(tile, pixels, valid, coverage, level): the share of pixels with a value in both times;
    `rejected` below ``low``, `low_quality` below ``normal``, else `normal`."""
    n = rows.groupBy(tile).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"))
    share = F.col("valid") / F.col("pixels")
    level = F.when(share < low, "rejected").when(share < normal, "low_quality").otherwise("normal")
    return n.select(tile, "pixels", "valid", share.alias("coverage"), level.alias("level"))


#: Around a pixel clockwise from its upper left corner: where a side begins and ends, as (row, col)
#: of corners, and the neighbour beyond it.
SIDES = (((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 1), (0, 1)), ((1, 1), (1, 0), (1, 0)), ((1, 0), (0, 0), (0, -1)))


def boundary(rows: DataFrame) -> DataFrame:
    """(component, r0, c0, r1, c1): the sides of pixels (tile, row, col, component) beyond which
    their component ends, directed with the component at the right."""
    sides = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc")) for i, (_, _, (dr, dc)) in enumerate(SIDES)])
    every = rows.select("tile", "component", "row", "col", F.explode(sides).alias("s")).select("tile", "component", "row", "col", "s.*")
    inside = rows.select("tile", "component", F.col("row").alias("nr"), F.col("col").alias("nc"))
    edge = every.join(inside, ["tile", "component", "nr", "nc"], "left_anti")
    corner = lambda end, axis: F.get(F.array(*[F.lit(s[end][axis]) for s in SIDES]), F.col("i"))
    return edge.select("component", *[(F.col(("row", "col")[axis]) + corner(end, axis)).cast("long").alias(f"{'rc'[axis]}{end}") for end in (0, 1) for axis in (0, 1)])


def measures(edges: DataFrame, step: float) -> DataFrame:
    """(component, edges, area, length): exact sums over a component's directed boundary, by the
    shoelace formula; holes run the other way, so their area goes off. Sides are summed where they
    lie, so a component with a third of all pixels costs a row for each task."""
    cross = F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")
    sums = edges.groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum(cross).alias("twice_area"))
    return sums.select("component", "edges", (F.col("twice_area") * step * step / 2).alias("area"), (F.col("edges") * step).alias("length"))


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """Closed rings of a component's sides. Where two rings touch at a corner the walk turns right,
    so that rings of 4-connected pixels don't cross."""
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in zip(*(rows[c].tolist() for c in ("r0", "c0", "r1", "c1")), strict=True):
        ends.setdefault((r0, c0), []).append((r1, c1))
    out = []
    for start in sorted(ends):
        while ends.get(start):
            ring, here, way = [start], ends[start].pop(), None
            way = (here[0] - start[0], here[1] - start[1])
            while here != start or ends.get(here) and (way[1], -way[0]) in [(r - here[0], c - here[1]) for r, c in ends[here]]:
                nexts = ends[here]
                right = (here[0] + way[1], here[1] - way[0])
                step = nexts.pop(nexts.index(right)) if right in nexts else nexts.pop()
                turn = (step[0] - here[0], step[1] - here[1])
                if turn != way:
                    ring.append(here)
                way, here = turn, step
            first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1])
            if first[0] * way[1] == first[1] * way[0] and (first[0] * way[0] + first[1] * way[1]) > 0:
                ring = ring[1:]  # the ring began in the middle of a line
            out.append(ring)
    twice = [sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, [*r[1:], r[0]], strict=True)) for r in out]
    return pd.DataFrame({"component": [int(rows["component"].iloc[0])] * len(out), "hole": [t < 0 for t in twice], "twice_area": twice, "ring": [[{"row": p[0], "col": p[1]} for p in [*r, r[0]]] for r in out]})


def polygons(edges: DataFrame) -> DataFrame:
    """(component, hole, twice_area, ring): closed rings of corners, collinear ones left out. One
    component's sides meet in one task, as its outline is one value."""
    return edges.groupBy("component").applyInPandas(_stitch, "component long, hole boolean, twice_area long, ring array<struct<row:long,col:long>>")


def change_polygons(rows: DataFrame, before: Column, after: Column, threshold: float, step: float, least_area: float = 500.0, low: float = 0.5, normal: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Where water came or went between two times: a table (component, tile, change, pixels, edges,
    area, length, level), and the outlines' edges (component, r0, c0, r1, c1) for ``polygons``.

    ``rows``: pixels (id, tile, row, col) of ``step`` metres. A pixel changes if its index passes the
    threshold at one time only; pixels without a value at either time don't. Gains and losses are
    components of their own; those below ``least_area`` square metres go, and so do tiles of which
    too few pixels have both values. An empty table gives empty ones.
    """
    good = coverage(rows, "tile", before.isNotNull() & after.isNotNull(), low, normal).filter("level <> 'rejected'").select("tile", "level")
    change = F.when((before <= threshold) & (after > threshold), "gain").when((before > threshold) & (after <= threshold), "loss")
    pixels = cut(rows.withColumn("change", change).filter("change is not null").select("id", "tile", "row", "col", "change").join(good, "tile"))
    found = reduce(DataFrame.unionByName, [components(pixels.filter(F.col("change") == c).select("id", "tile", "row", "col")) for c in ("gain", "loss")])
    placed = cut(pixels.join(found, "id"))
    large = placed.groupBy("component", "tile", "change", "level").agg(F.count(F.lit(1)).alias("pixels")).filter(F.col("pixels") * step * step >= least_area)
    edges = cut(join_split(boundary(placed), large.select("component"), "component", by="r0"))
    return large.join(measures(edges, step), "component").select("component", "tile", "change", "pixels", "edges", "area", "length", "level"), edges


def resize_geometry(width: Column, height: Column, size: int) -> tuple[Column, ...]:
    """New width, new height, left and top of an image that is scaled by its longer side and
    centred on a square."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    w, h = (F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (width, height))
    return w, h, F.floor((size - w) / 2).cast("int"), F.floor((size - h) / 2).cast("int")
