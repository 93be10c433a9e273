"""File manifests: numbering, sequences, duplicates, summaries, review queues."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .persist import cut

#: Frames of one window partition.
FRAMES = 100_000
#: A class with at most so many rows is a minority.
MINORITY = 60


def positions(df: DataFrame, *order: Column | str, name: str = "position", first: int = 0) -> DataFrame:
    """Adds each row's place in a total order, without one task that sees all rows: range
    partitions are numbered inside, and each gets the rows before it as an offset."""
    key = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = cut(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # a row for each partition
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + at + first).drop("_id", "_part", "_before")


def first_by(df: DataFrame, keys: list[str], *order: Column | str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key, by an aggregation that combines before the shuffle: a
    hot key costs one row for each task."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def last_of_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position; blank and null keys go."""
    return first_by(df.filter(F.coalesce(F.trim(key), F.lit("")) != ""), [key], position, last=True)


def ranks(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Adds ``rank`` (from 1) and ``rank_n`` (rows) in each key's order. Rows are numbered in one
    order of keys and rows, so that a key with a third of all rows is spread over many tasks."""
    rows = positions(df, *keys, *order, name="_p")
    starts = rows.groupBy(*keys).agg(F.min("_p").alias("_s"), F.count(F.lit(1)).alias("rank_n"))
    starts = cut(starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_s", "rank_n"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(starts, same).select(*df.columns, (F.col("_p") - F.col("_s") + 1).alias("rank"), "rank_n")


def sequence_blocks(rows: DataFrame, frame: str = "frame_id", gap: int = 1, prefix: str = "file_block_") -> DataFrame:
    """Adds ``sequence_id``: a new block begins where a frame is more than ``gap`` behind the one
    before it; null frames share one name. Frames are numbered in ranges with carried offsets."""
    frames = rows.filter(F.col(frame).isNotNull()).select(F.col(frame).alias("_f")).distinct().withColumn("_b", F.floor(F.col("_f") / FRAMES))
    ranges = frames.groupBy("_b").agg(F.max("_f").alias("_last"))
    ranges = cut(ranges.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_prior")))
    inside = Window.partitionBy("_b").orderBy("_f")
    flagged = frames.join(ranges, "_b").withColumn("_prev", F.coalesce(F.lag("_f").over(inside), "_prior"))
    flagged = cut(flagged.withColumn("_new", F.coalesce((F.col("_f") - F.col("_prev") > gap).cast("int"), F.lit(1))))
    counts = flagged.groupBy("_b").agg(F.sum("_new").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    numbered = flagged.join(before, "_b").select(F.col("_f").alias(frame), (F.col("_before") + F.sum("_new").over(inside) - 1).alias("_block"))
    name = F.coalesce(F.format_string(prefix + "%04d", F.col("_block")), F.lit(prefix + "unknown"))
    return rows.join(numbered, frame, "left").withColumn("sequence_id", F.when(F.col("_block").isNull(), F.lit(prefix + "unknown")).otherwise(name)).drop("_block")


def duplicate_groups(rows: DataFrame, digest: str = "sha256", path: str = "relative_path") -> DataFrame:
    """(digest, n, first_path, duplicate_group) of digests with two or more rows, numbered by
    their first paths. Rows without a digest aren't grouped."""
    groups = rows.filter(F.coalesce(digest, F.lit("")) != "").groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first_path")).filter("n > 1")
    return positions(groups, "first_path").withColumn("duplicate_group", F.format_string("dup_%04d", F.col("position"))).drop("position")


def group_type(split: str = "split") -> Column:
    """Where a group's rows lie."""
    has = lambda x: F.bool_or(F.col(split) == x)
    only = lambda *x: F.bool_and(F.col(split).isin(*x))
    return F.when(only("train"), "train_train").when(only("test"), "test_test").when(only("train", "test") & has("train") & has("test"), "train_test").otherwise("other_split")


def later_duplicates(rows: DataFrame) -> DataFrame:
    """(filename, training_use, reason) of labelled train rows: all but the first of equal digests
    by (frame, path) are disabled; rows without a digest stay."""
    some = rows.filter("split = 'train' and label is not null").select("filename", "sha256", "frame_id", "relative_path")
    order = F.struct(F.col("frame_id").isNull(), "frame_id", "relative_path")
    first = cut(some.groupBy("sha256").agg(F.min_by("relative_path", order).alias("first_path")))
    later = (F.coalesce("sha256", F.lit("")) != "") & (F.col("relative_path") != F.col("first_path"))
    used = some.join(first, "sha256", "left")
    return used.select("filename", F.coalesce(~later, F.lit(True)).alias("training_use"), F.when(later, "later_exact_duplicate").otherwise("").alias("training_exclusion_reason"))


def histogram(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., labels): `label:count` of each label in order, joined by `;`."""
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    said = F.struct(F.col(label).alias("l"), F.concat_ws(":", label, F.col("n").cast("string")).alias("s"))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), ";").alias("labels"))


def sequence_summary(rows: DataFrame) -> DataFrame:
    """Counts by split and the label histogram of each sequence."""
    n = rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("total_count"), *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "val", "test")])
    return n.join(histogram(rows.withColumn("label", F.coalesce("label", F.lit("unlabeled"))), ["sequence_id"], "label"), "sequence_id")


def review_queue(rows: DataFrame, minority: int = MINORITY) -> DataFrame:
    """(filename, label, reasons, priority): labelled rows with a reason for review. Priority 1 for
    classes of at most ``minority`` rows, else 2."""
    labelled = rows.filter("label is not null")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("label_n"))
    dups = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("same_n"))
    rows = labelled.join(F.broadcast(counts), "label").join(dups, "sha256", "left")
    few = F.col("label_n") <= minority
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(few, "minority_class"), F.when(F.col("same_n") > 1, "exact_duplicate"),
        F.when((F.col("width") != F.col("declared_width")) | (F.col("height") != F.col("declared_height")), "size_mismatch"), F.when(F.col("frame_id").isNull(), "no_frame"),
    )))
    return rows.select("filename", "label", F.concat_ws(";", reasons).alias("reasons"), F.when(few, 1).otherwise(2).alias("priority")).filter("reasons <> ''")


def digest(rows: DataFrame, *order: str) -> DataFrame:
    """One digest of a table in any order of its rows: of 65,536 parts by row digest, each the
    digest of its sorted row digests with the number of equal rows, so that neither a list of all
    rows nor one of many equal rows is built. A value counts by the digest of its text, a null as a
    dash."""
    row = F.sha2(F.concat(*[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in order]), 256)
    equal = rows.groupBy(row.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    said = F.concat_ws(":", "h", F.col("n").cast("string"))
    parts = equal.select(said.alias("h")).groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ";"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def resolve_paths(rows: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """(filename, path, n_candidates) for rows (filename): the path of ``known`` (filename,
    relative_path), else the only one of ``candidates`` (filename, n_paths, first_path). A null path
    with n_candidates other than 1 couldn't be resolved."""
    found = rows.join(known.select("filename", "relative_path"), "filename", "left").join(candidates, "filename", "left")
    n = F.coalesce("n_paths", F.lit(0).cast("long"))
    return found.select("filename", F.coalesce(F.nullif("relative_path", F.lit("")), F.when(n == 1, F.col("first_path"))).alias("path"), n.alias("n_candidates"))
