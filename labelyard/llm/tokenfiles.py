"""Token ids of documents in ORC files, in the order of document ids.

ORC stores integers with run-length encoding (bit-packed where they don't repeat), keeps least and
largest document ids of every stripe and of every ROW_INDEX rows in it, and Bloom filters on the
document ids. As files and their stripes follow the ids, a reader that wants some ids skips the
stripes and row groups of all others by these figures alone; Bloom filters tell of ids that lie in
a group's range but not in the group. Stripes are read independently, several tasks to a file.

``write_tokens`` encodes in the task that writes. ``read_tokens`` reads whole files or some ids,
``read_counts`` the files' documents with their places in the sequence of all ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.persist import checkpoint_folder, cut
from .packing import END_ID, blocks, encoder

SCHEMA = "doc_id long, ids array<int>"
#: Bytes of a stripe before compression, and rows between entries of the row index.
STRIPE_BYTES, ROW_INDEX = 16 << 20, 1000
#: Rows after which the writer looks whether a stripe is full; documents may be long.
LOOK_ROWS = 100
#: False hits that a Bloom filter may have.
FALSE_HITS = 0.01


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each document's ids and then ``end_id``. Null and empty texts give the single
    ``end_id``; null ids and repeated rows stay."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in blocks(it):
            ids, ends = encode(batch.column(1))
            ends = ends.astype(np.int64)
            own = np.insert(ids.astype("i4"), ends, end_id)
            offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, row_index: int = ROW_INDEX) -> None:
    """Writes ``docs`` (doc_id, text) to ORC files under ``path``, which must not exist.

    Files follow the document ids (null ids first). Texts are shuffled once, before they are
    encoded. The rows of one id are spread by hashes of their texts and then of their places, so
    one id may fill several files.
    """
    key = ["doc_id", "_t", "_h"]
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"_t": F.xxhash64("text"), "_h": F.xxhash64(F.monotonically_increasing_id())})
    placed = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_index, "orc.rows.between.memory.checks": LOOK_ROWS, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_HITS}
    encoded(placed, tokenizer, end_id).write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Iterable[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, ids) of the files: all, or those with one of ``ids`` or from ``low`` to ``high``.
    The conditions reach the reader, which prunes files' stripes and row groups by them."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if ids is not None:
        rows = rows.filter(F.col("doc_id").isin([int(i) for i in ids]))
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files, read stripe by stripe.

    ``start`` counts the ids of all documents before. A row for each file is ordered in one task;
    inside a file rows are in the order of its splits and of the rows in these.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n, pa.array(crc, pa.int64())], names=["doc_id", "_file", "_split", "_row", "n_tokens", "ids_crc32"])

    # Spark numbers the files of a write by its partitions, part-00000 on
    number = F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).cast("long")
    here: list[Column] = [number.alias("_file"), F.input_file_block_start().alias("_split"), F.monotonically_increasing_id().alias("_row")]
    rows = read_tokens(spark, path).select("doc_id", *here, "ids").mapInArrow(run, "doc_id long, _file long, _split long, _row long, n_tokens long, ids_crc32 long")
    rows = cut(rows)  # read the files once
    files = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_split", "_row")) - F.col("n_tokens")
    return rows.withColumn("_inside", inside).join(before, "_file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def written_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` to new files in the shared checkpoint folder and describes what they hold."""
    path = f"{checkpoint_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path)
    return read_counts(docs.sparkSession, path)
