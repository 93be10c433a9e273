"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The vocabulary is a ranks file (base64 token, rank). Bytes map to printable characters by the
usual byte-level table, a BPE model is made with every pair of tokens whose concatenation is a
token, in the order of that token's rank, and each match of the split pattern is encoded by
itself. Decoding reverses the byte table on the joined token strings, so a character whose bytes
fall into several tokens comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, leave

#: Chunks, and matches, whose ids a worker remembers.
CACHE_PIECES = 500_000
BESIDE_SPACE = re.compile(r" \s|\s |^ | $").search


def byte_table() -> list[str]:
    """A printable character for each byte: Latin-1's own where printable, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, spare = [""] * 256, iter(range(256, 512))
    for b in range(256):
        table[b] = chr(b) if b in own else chr(next(spare))
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """``encode``: ids of a text as little-endian uint32 bytes. ``decode``: the text's bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        table = byte_table()
        spell = lambda token: "".join(map(table.__getitem__, token))
        pairs = []
        for token, rank in ranks.items():
            pairs += [(rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        pairs.sort()
        vocab = {spell(t): r for t, r in ranks.items()}
        model = models.BPE(vocab=vocab, merges=[(spell(a), spell(b)) for *_, a, b in pairs], ignore_merges=True)
        self.model = Tokenizer(model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # decoding: each token's characters, turned back by the byte that a character stands for
        back = {c: b for b, c in enumerate(table)}
        self.bytes = [b""] * (self.model.get_vocab_size() and max(vocab.values()) + 1)
        for s, r in self.model.get_vocab().items():
            self.bytes[r] = bytes(map(back.__getitem__, s))

    def _learn(self, chunks: list[str]) -> None:
        split, pieces = [self.split(c) for c in chunks], self.pieces
        new = list({p for own in split for p in own if p not in pieces})
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                pieces[p] = np.array(e.ids, "<u4").tobytes()
        for c, own in zip(chunks, split, strict=True):
            self.known[c] = b"".join(map(pieces.__getitem__, own))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A single space between two other characters always begins a match, so texts are taken
        apart there, and a distinct chunk is split and encoded once. Texts with other white space
        beside a space are split whole."""
        for cache in (self.known, self.pieces):
            if len(cache) > CACHE_PIECES:
                cache.clear()
        split = []
        for t in texts:
            if BESIDE_SPACE(t):
                split.append([t])
            else:
                first, *rest = t.split(" ")
                split.append([first, *map(" ".__add__, rest)])
        known = self.known
        if new := list({c for chunks in split for c in chunks if c not in known}):
            self._learn(new)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for chunks in split:  # whole texts aren't worth keeping
            if len(chunks) == 1:
                known.pop(chunks[0], None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each token of ``text`` in its UTF-8 bytes."""
        out, at = [], 0
        for i in np.frombuffer(self.encode([text])[0], "<u4").tolist():
            out.append((i, at, at + len(self.bytes[i])))
            at += len(self.bytes[i])
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process, until another operator takes it over."""
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    leave("bytebpe", _codecs.clear)
    return _codecs[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): the whole text's ids as little-endian uint32. A null text is empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch, texts in batches(it, owner="bytebpe"):
            ids = own.encode([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for; null ids give empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch, ids in batches(it, "ids", "bytebpe"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest row of each document, JVM-side."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def brute(text: str | None, encoding) -> tuple[int, str, str]:
    """What ``digests`` should give, by another library's encoding; for tests."""
    ids = encoding.encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()
