"""Pixels of the image source (BGR bytes) as hashes and vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of brightness; one, three or four channels."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return x[:, :, 0]
    return x[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def _shrink(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means; each target cell covers at least one source row and column."""

    def groups(size: int, parts: int) -> np.ndarray:
        edge = np.linspace(0, size, parts + 1)
        cover = np.minimum(np.arange(1, size + 1)[None], edge[1:, None]) - np.maximum(np.arange(size)[None], edge[:-1, None])
        cover = np.maximum(cover, 0)
        return cover / cover.sum(axis=1, keepdims=True)

    return groups(x.shape[0], height) @ x @ groups(x.shape[1], width).T


def difference_bits(x: np.ndarray, height: int = 8, width: int = 9) -> int:
    """64 bits, row by row, the first highest: whether a cell is brighter than its right neighbour."""
    cells = np.round(_shrink(x, height, width))
    out = 0
    for bit in (cells[:, :-1] > cells[:, 1:]).ravel():
        out = out << 1 | int(bit)
    return out


def difference_hash(image: Column | str) -> Column:
    """The difference hash of an image struct as 16 hex digits; null where it can't be decoded."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in parts:
            rows = zip(p["data"], p["height"], p["width"], p["nChannels"], strict=True)
            yield pd.Series([f"{difference_bits(_grey(d, h, w, c)):016x}" if w and w > 0 else None for d, h, w, c in rows], dtype=object)

    return run(image)


def thumbnail(image: Column | str, height: int = 36, width: int = 48) -> Column:
    """A centred brightness vector of length 1 of an image struct, for cosines; null where it can't
    be decoded."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in parts:
            out = []
            for d, h, w, c in zip(p["data"], p["height"], p["width"], p["nChannels"], strict=True):
                if not w or w <= 0:
                    out.append(None)
                    continue
                v = _shrink(_grey(d, h, w, c), height, width).ravel()
                v -= v.mean()
                out.append(v / max(float(np.linalg.norm(v)), 1e-12))
            yield pd.Series(out, dtype=object)

    return run(image)


def turned(x: np.ndarray, orientation: int) -> np.ndarray:
    """Rows x columns (x channels) as they are seen upright, from an EXIF orientation of 1 to 8."""
    if orientation >= 5:
        x = np.swapaxes(x, 0, 1)
    if orientation in (3, 4, 7, 8):
        x = x[::-1]
    if orientation in (2, 3, 6, 7):
        x = x[:, ::-1]
    return x


def upright_rgb(image: Column | str, orientation: Column | str) -> Column:
    """(height, width, data) of an image struct, turned upright by its EXIF orientation, as rows of
    red, green and blue bytes; grey is repeated and transparency left out. Null where it can't be
    decoded; a null orientation is 1."""

    @F.pandas_udf("height int, width int, data binary")
    def run(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, o in parts:
            rows = []
            for d, h, w, c, turn in zip(p["data"], p["height"], p["width"], p["nChannels"], o, strict=True):
                if not w or w <= 0:
                    rows.append((None, None, None))
                    continue
                x = np.frombuffer(d, np.uint8).reshape(h, w, c)
                x = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]
                x = turned(x, 1 if pd.isna(turn) else int(turn))
                rows.append((x.shape[0], x.shape[1], x.tobytes()))
            yield pd.DataFrame(rows, columns=["height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})

    return run(image, orientation)


def hash_to_long(hex16: Column | str) -> Column:
    """16 hex digits as a signed long."""
    return F.conv(hex16, 16, -10).cast("bigint")
