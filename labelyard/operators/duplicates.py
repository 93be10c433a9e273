"""Near-duplicate frames by hash distance, and what follows from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hamming


def near_pairs(rows: DataFrame, gap: int, distance: int) -> DataFrame:
    """(left_id, right_id, delta, distance) of rows (id, dir, frame, sha256, hash) of a directory
    with 0 <= delta <= gap frames, other digests and hashes at most ``distance`` bits apart.

    A band join: frames fall into buckets of gap + 1, and a row meets its own bucket and the
    next, so that work grows with the rows in gap, not with the directory.
    """
    wide = gap + 1
    rows = rows.filter("frame is not null and hash is not null")
    bucket = F.floor(F.col("frame") / wide)
    cols = ("id", "frame", "sha256", "hash")
    left = rows.select("dir", bucket.alias("bucket"), *[F.col(c).alias(f"left_{c}") for c in cols])
    right = rows.select("dir", F.explode(F.array(bucket, bucket - 1)).alias("bucket"), *[F.col(c).alias(f"right_{c}") for c in cols])
    delta = F.col("right_frame") - F.col("left_frame")
    apart = hamming(F.col("left_hash"), F.col("right_hash"))
    ordered = (delta > 0) | ((delta == 0) & (F.col("left_id") < F.col("right_id")))
    pairs = left.join(right, ["dir", "bucket"]).filter(ordered & (delta <= gap) & (F.col("left_sha256") != F.col("right_sha256")) & (apart <= distance))
    return pairs.select("left_id", "right_id", delta.alias("delta"), apart.cast("int").alias("distance"))


def equal_digest_edges(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(a, b): each later row of a digest with its first."""
    first = rows.groupBy(digest).agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, digest).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def leaking_pairs(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) whose ends (id, fold) lie in different folds."""
    a = folds.select(F.col("id").alias("left_id"), F.col("fold").alias("left_fold"))
    b = folds.select(F.col("id").alias("right_id"), F.col("fold").alias("right_fold"))
    return pairs.join(a, "left_id").join(b, "right_id").filter("left_fold <> right_fold").select("left_id", "right_id", "left_fold", "right_fold")


def leaking_groups(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(group, folds) of groups that lie in more than one fold."""
    n = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_set(fold)).alias("f"))
    return n.filter(F.size("f") > 1).select(group, F.array_join("f", ",").alias("folds"))
