"""Best-fit packing of tokenised documents into fixed-length training sequences.

Two steps. ``tokenized_pieces`` encodes whole documents and cuts only those longer than a
sequence. ``pack`` places pieces by bounded-space online best fit: each task keeps a fixed number
of open bins, indexed by a bitset whose bit *f* says that a bin with *f* free tokens is open. The
best bin for a piece is the lowest set bit at or above its length; when every bin is taken, the
fullest (the lowest set bit) closes. What is still open and not nearly full at a task's end goes
through a second round of the same kind, largest first, in tasks of a fixed number of pieces and of
open bins, so the loss doesn't grow with the number of tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, leave, take_over

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 1024
#: A bin with no more free tokens than this at a task's end stays as it is.
CLOSE_ENOUGH = 32
#: Pieces that one task of the second round takes, and its open bins.
SECOND_ROUND, SECOND_BINS = 16_384, 2048
#: Words whose ids a worker remembers.
CACHE_WORDS = 800_000
#: Bytes of text that a worker encodes at once.
BLOCK_BYTES = 1 << 23
#: How special tokens begin.
SPECIAL = "<|"
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x01"
#: Punctuation that may follow a word.
TAIL = ".,;:!?)]}\"#$%&*"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts; every distinct word is encoded once and remembered.

    The tokenizer drops white space, and none of its matches crosses any, so a text's ids are the
    ids of its parts in order, wherever ASCII white space parts it. It lower-cases, so ASCII
    letters may be lower-cased first, but not where a special token may stand, as these are matched
    before. Punctuation without an apostrophe behind a Latin-1
    letter or digit is a match of its own.

    ``at`` has each word's index in ``start`` and ``size`` (its span in ``ids``) and ``used`` (the
    last block that had it). Beyond CACHE_WORDS the half that was used longest ago goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        (self.mark,) = self.model.encode(MARK, add_special_tokens=False).ids
        self.at: dict[str, int] = {}
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.block = np.zeros(0, "<u4"), 0

    def _ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and where each word's end."""
        size = self.size[places]
        end = np.cumsum(size, dtype=np.int64)
        at = np.repeat((self.start[places] - (end - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], end

    def _add(self, words: list[str], ids: np.ndarray, end: np.ndarray) -> None:
        start = np.concatenate(([0], end[:-1]))
        self.start = np.concatenate((self.start, len(self.ids) + start))
        self.size = np.concatenate((self.size, (end - start).astype(np.int32)))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int32)))
        self.ids = np.concatenate((self.ids, ids))
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Adds new words. Many are encoded as one text, with a mark between them."""
        whole, split, alone = [], [], []
        for w in words:
            if SPECIAL in w or MARK in w:
                alone.append(w)
                continue
            core = w.rstrip(TAIL)
            # beyond Latin-1, NFC or lower case may put a mark behind a letter
            if len(core) < len(w) and core[-1:].isalnum() and core[-1] < "\u0100":
                split.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        parts = [w for w in dict.fromkeys([*whole, *(x for _, *own in split for x in own)]) if w not in self.at]
        ids, end = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            got = np.array(self.model.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, "<u4")
            marks = np.append(np.flatnonzero(got == self.mark), len(got))
            if len(marks) != len(some):
                raise ValueError("the mark isn't a match of its own")
            end.append(marks - np.arange(len(some)) + sum(map(len, ids)))
            ids.append(got[got != self.mark])
        for w in alone:
            ids.append(np.array(self.model.encode(w, add_special_tokens=False).ids, "<u4"))
            end.append(np.array([sum(map(len, ids))]))
        self._add([*parts, *alone], np.concatenate(ids), np.concatenate(end))
        if split := [x for x in split if x[0] not in self.at]:
            ids, end = self._ids_of(np.array([self.at[x] for _, *own in split for x in own]))
            self._add([w for w, *_ in split], ids, end[1::2])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE_WORDS // 2])
        words = list(self.at)
        ids, end = self._ids_of(keep)
        used = self.used[keep]
        self.at, self.start, self.size, self.used, self.ids = {}, self.start[:0], self.size[:0], self.used[:0], self.ids[:0]
        self._add([words[i] for i in keep.tolist()], ids, end)
        self.used = used

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array's values (null: empty), and where each value's ids end."""
        if len(self.at) > CACHE_WORDS:
            self._forget()
        self.block += 1
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.at]:
            self._learn(new)
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.used[places] = self.block
        ids, end = self._ids_of(places[coded.indices.to_numpy()])
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return ids, np.concatenate(([0], end))[last]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, until another operator takes it over."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    leave("packing", _encoders.clear)
    return _encoders[path]


def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to BLOCK_BYTES, as a block's distinct words are looked up once. Before
    the first one, what other operators have left here is forgotten; behind the last one, memory is
    given back."""
    take_over("packing")
    held: list[pa.RecordBatch] = []
    for batch in it:
        if held and sum(b.nbytes for b in held) + batch.nbytes > BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)
    held, batch = [], None
    give_back()


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: each document's ids and then ``end_id``.

    A null text is an empty one and gives the single token ``end_id``. Repeated rows give repeated
    pieces. ``keep_ids`` adds ``ids`` (array<int>), for writing sequences out.
    """
    last = np.array([end_id], "<u4")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in blocks(it):
            ids, ends = encode(batch.column(1))
            rows: list[tuple] = []
            parts: list = []
            begin = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                total = end - begin + 1
                for piece, at in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - at)
                    part = ids[begin + at : min(begin + at + length, end)]
                    crc = zlib.crc32(part)
                    rows.append((doc_id, piece, at, length, zlib.crc32(last, crc) if len(part) < length else crc))
                    if keep_ids:
                        parts.append(np.concatenate((part, last))[:length].astype("i4"))
                begin = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


class BestFit:
    """The open bins. ``place`` returns the bins that closed on the way, as lists of items."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.bins, self.count, self.bits = capacity, bins, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _push(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> list:
        same = self.by_free[free]
        items = same.pop()
        if not same:
            self.bits ^= 1 << free
        self.count -= 1
        return items

    def place(self, size: int, item: object) -> list[list]:
        closed = []
        if size == self.capacity:
            return [[item]]
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._pop(free)
        else:
            if self.count >= self.bins:
                closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
            free, items = self.capacity, []
        items.append(item)
        if free == size:
            closed.append(items)
        else:
            self._push(free - size, items)
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        for free in sorted(self.by_free):
            for items in self.by_free[free]:
                yield free, items


def _packer(capacity: int, bins: int, last: bool, first_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sequence = BestFit(capacity, bins), first_id + (TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []

        def close(items: list) -> None:
            nonlocal sequence
            offset = 0
            for item in items:
                rows.append((*item[:5], sequence, offset))
                offset += item[3]
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in it:
            for item in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                for items in space.place(item[3], item):
                    close(items)
            if rows:
                yield flush()
        for free, items in space.rest():
            if last or free <= CLOSE_ENOUGH:
                close(items)
            else:
                rows.extend((*item[:5], None, None) for item in items)
        yield flush()

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    Lengths must lie between 1 and ``capacity``. Offsets in a sequence are gapless from 0; ties go
    to the bin that was touched last. An empty input gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = cut(pieces.select(*names).mapInArrow(_packer(capacity, open_bins, False, 0), PACKED))
    left = placed.filter("sequence_id is null")
    parts = max(1, -(-left.count() // SECOND_ROUND))
    order = [F.desc("length"), "doc_id", "piece", "start"]
    again = left.select(*names).repartition(parts).sortWithinPartitions(*order).mapInArrow(_packer(capacity, SECOND_BINS, True, 1 << 62), PACKED)
    return placed.filter("sequence_id is not null").unionByName(again)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """Each sequence's ids in order: (sequence_id, ids array<int>)."""
    keyed = packed.join(pieces_with_ids.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    return keyed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
