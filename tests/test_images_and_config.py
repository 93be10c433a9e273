"""Pixel functions and configuration checks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelyard.functions import images
from labelyard.operators import manifest
from labelyard.sources import config, readers


def png(pixels: np.ndarray) -> bytes:
    rows = np.zeros((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    rows[:, 1:] = pixels
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def test_hashes(spark, tmp_path):
    (tmp_path / "down.png").write_bytes(png(np.tile(np.arange(180, 0, -10, dtype=np.uint8), (16, 1))))
    (tmp_path / "up.png").write_bytes(png(np.tile(np.arange(0, 180, 10, dtype=np.uint8), (16, 1))))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = spark.read.format("image").load(str(tmp_path)).select(readers.basename("image.origin").alias("n"), images.difference_hash("image").alias("h"), images.thumbnail("image").alias("t"))
    got = {r["n"]: r for r in rows.collect()}
    assert got["down.png"]["h"] == "f" * 16 and got["up.png"]["h"] == "0" * 16 and got["bad.png"]["h"] is None
    assert np.dot(got["down.png"]["t"], got["up.png"]["t"]) == pytest.approx(-1, abs=1e-6)
    sizes = {r["image_ok"] for r in readers.decoded_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {True, False}
    assert spark.range(1).select(images.hash_to_long(F.lit("f" * 16))).first()[0] == -1


def test_label_map(tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"b": 1, "a": 0}))
    assert config.label_map(str(p), ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        config.label_map(str(p), ["b", "a"])
    p.write_text(json.dumps({"b": 2, "a": 0}))
    with pytest.raises(ValueError):
        config.label_map(str(p))


def test_ensemble():
    good = [{"fold": k, "weight": 0.5, "path": f"m/{k}.bin", "sha256": "a" * 64} for k in (1, 0)]
    assert [m["fold"] for m in config.check_ensemble({"members": good}, 2)] == [0, 1]
    for change in ({"weight": 0.6}, {"path": "../x"}, {"path": "C:/x"}, {"sha256": "zz"}, {"fold": 0}):
        with pytest.raises(ValueError):
            config.check_ensemble({"members": [good[0] | change, good[1]]}, 2)


def test_resolve_paths(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "filename string")
    known = spark.createDataFrame([("a", "x/a"), ("b", "")], "filename string, relative_path string")
    found = spark.createDataFrame([("b", 1, "y/b"), ("c", 2, "y/c")], "filename string, n_paths long, first_path string")
    got = {r["filename"]: (r["path"], r["n_candidates"]) for r in manifest.resolve_paths(rows, known, found).collect()}
    assert got == {"a": ("x/a", 0), "b": ("y/b", 1), "c": (None, 2), "d": (None, 0)}
