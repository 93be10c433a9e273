"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_split, key_counts, part_rows
from .manifest import positions
from .persist import cut, remove, written


def _joined(rows: DataFrame, table: DataFrame, key: str, by: str, hot: bool, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    return join_split(rows, table, key, by=by, how=how, counts=counts) if hot else rows.join(table, key, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component: the smallest id reachable.

    Each round hooks every id to its smallest neighbour, follows hooks to their roots by doubling
    steps, and contracts the edges to roots. A chain takes one round and as many doublings as its
    length has bits, a star two rounds at most. Ids with many neighbours, and roots with many ids,
    are split in joins; whether there are any comes with the counts that end the doubling. A table
    is deleted when the next one replaces it.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        hook = table = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("up"), F.count(F.lit(1)).alias("n")))
        degree, ends, ids = hook.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
        many = degree > part_rows(ends // 2)
        fan = degree  # ids that hook to the same one are its neighbours
        while True:
            above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            step = written(_joined(hook.select("id", "up"), above, "up", "id", fan > part_rows(ids)).select("id", "up", "top"))
            moved, fan = step.groupBy("top").agg(F.count_if(F.col("up") != F.col("top")).alias("moved"), F.count(F.lit(1)).alias("n")).agg(F.sum("moved"), F.max("n")).first()
            remove(table)
            hook, table = step.select("id", F.col("top").alias("up")), step
            if not moved:
                break
        one = hook.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        two = hook.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        left = _joined(_joined(edges, two, "b", "a", many), one, "a", "b", many, counts=key_counts(edges, "a") if many else None)
        fewer = written(left.filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        remove(edges)
        edges = fewer
        if found is None:
            found, kept = hook.select("id", F.col("up").alias("component")), table
        else:
            above = hook.select(F.col("id").alias("component"), F.col("up").alias("top"))
            # ids of one component are those that came together before
            again = written(join_split(found, above, "component", by="id", how="left").select("id", F.coalesce("top", "component").alias("component")))
            remove(table)
            remove(kept)
            found, kept = again, again
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def members(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every row of ``vertices`` (id); alone: its own component."""
    return vertices.join(components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def numbered(found: DataFrame, prefix: str, first: int = 0) -> DataFrame:
    """Adds ``group_id``: components of two or more members in order of their smallest id, as
    prefix and four digits."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    order = cut(positions(sizes, "component", name="i", first=first))
    return join_split(found, order, "component", by="id").select("id", "component", F.format_string(prefix + "%04d", F.col("i")).alias("group_id"))
