"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.persist import cut as cut

#: Rows in an Arrow batch; texts may be long, so a batch must stay small.
BATCH_ROWS = 1024
#: Bytes of text that a numpy kernel takes at once; it needs about 75 times as many.
CHUNK_BYTES = 1 << 19

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; ids that are null get null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null gives empty."""
    return [b or b"" for b in pc.cast(column, pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Returns memory that isn't used to the system. A worker process lives on when its task ends,
    and what its allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: How to forget what an operator's tasks have left in this worker process for their next ones.
_left: dict[str, Callable[[], None]] = {}


def leave(owner: str, forget: Callable[[], None]) -> None:
    """Says that the tasks of ``owner`` leave something in this process, until ``forget`` is called."""
    _left[owner] = forget


def take_over(owner: str = "") -> None:
    """Forgets what tasks of other operators than ``owner`` have left in this process. A worker is
    handed from one operator to the next, and what it remembers counts against the executor."""
    if others := [name for name in _left if name != owner]:
        for name in others:
            _left.pop(name)()
        give_back()


def batches(it: Iterator[pa.RecordBatch], column: str = "text", owner: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most CHUNK_BYTES of text (one row at least), with that text.
    Before the first one, what other operators have left here is forgotten; behind the last one,
    memory is given back."""
    take_over(owner)
    for batch in it:
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        start, held = 0, 0
        for i, t in enumerate(texts):
            if i > start and held + len(t) > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        batch = texts = None
    give_back()


class Words:
    """Words of many texts in one pass: `[^\\x20\\x09-\\x0D]+` over the bytes.

    ``hashes`` has a 64-bit hash for each word in order, ``first`` the index of each text's first
    word (and the total at its end), ``start``/``stop`` each word's bytes in ``buf``.
    """

    SPACE = np.zeros(256, bool)
    SPACE[[0x20, *range(0x09, 0x0E)]] = True
    _rng = np.random.default_rng(20240229)
    CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    BASE = 0x5851F42D4C957F2D
    _pow = _inv = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            n = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
            for name, b in (("_pow", cls.BASE), ("_inv", pow(cls.BASE, -1, 2**64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls._pow, cls._inv

    def __init__(self, texts: list[bytes], space: np.ndarray | None = None):
        """space: for each byte value, whether it parts words (else white space does)."""
        self.buf = buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        n = len(buf)
        space = (self.SPACE if space is None else space)[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.stop = edge[0::2], edge[1::2]
        pw, inv = self.powers(n)
        value = self.CODE[buf] * pw[:n]
        total = np.cumsum(value, dtype=np.uint64)
        s, e = self.start, self.stop
        self._sums = total, value, inv
        self.hashes = mix((total[e - 1] - total[s] + value[s]) * inv[s]) if len(s) else np.zeros(0, np.uint64)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)

    def prefixes(self, k: int, which: np.ndarray) -> np.ndarray:
        """Hashes of the first k bytes of the words in ``which``; they must be longer."""
        total, value, inv = self._sums
        s = self.start[which]
        return mix((total[s + k - 1] - total[s] + value[s]) * inv[s] + np.uint64(int(GOLD) * k % 2**64))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one row for each labelled document; of repeated rows the more frequent value,
    1 in a tie. Null ids and values go."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def kept_rows(docs: DataFrame, scorer: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``scorer()`` says true of. ``scorer`` is
    called once in each task. No rows move between tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch, texts in batches(it):
            yield batch.filter(pa.array(np.asarray(of(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
