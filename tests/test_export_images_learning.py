"""Ordered exports, image headers, throughput and fold regressions against plain versions."""

import csv
import io
import json
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelyard.functions import images as pixels
from labelyard.operators import learn
from labelyard.sources import export, images, readers, writers

# exports


def text_of(spark, path, tmp_path):
    to = str(tmp_path / "one")
    export.joined(spark, path, to)
    with open(to, "rb") as f:
        return f.read()


@pytest.fixture()
def tricky(spark):
    said = ['a "quoted" word', "two\nlines", "comma, here", "", None, "naïve 日本", " padded ", "tab\there", "\\back\\", '"', "end\r\n"]
    rows = [(i, said[i % len(said)], None if i % 7 == 0 else i / 4, i % 2 == 0) for i in range(500)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k long, said string, x double, flag boolean").repartition(6)


def test_csv_parts_are_one_ordered_file(spark, tricky, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_ROWS", 60)
    path = str(tmp_path / "csv")
    export.ordered_csv(tricky, path, ["k"], ["k", "said", "x"])
    text = text_of(spark, path, tmp_path).decode()
    assert text.startswith("﻿k,said,x\n")
    rows = list(csv.reader(io.StringIO(text[1:], newline="")))
    want = sorted((r["k"], r["said"], r["x"]) for r in tricky.collect())
    assert rows[1:] == [[str(k), s or "", "" if x is None else str(x)] for k, s, x in want]
    back = export.read_csv(spark, path, "k long, said string, x double").orderBy("place").collect()
    assert [r["place"] for r in back] == list(range(500)) and [(r["k"], r["x"]) for r in back] == [(k, x) for k, _, x in want]
    assert [r["said"] or "" for r in back] == [s or "" for _, s, _ in want]
    names = [p["name"] for p in export.manifest(spark, path)["parts"]]
    assert len(names) > 8 and names[0] == export.BEGIN and names[1:] == sorted(names[1:])
    assert export.damaged_parts(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        export.ordered_csv(tricky, path, ["k"])


def test_damaged_parts_are_told(spark, tricky, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_ROWS", 60)
    path = tmp_path / "csv"
    export.ordered_csv(tricky, str(path), ["k"])
    names = [p["name"] for p in export.manifest(spark, str(path))["parts"] if p["name"].startswith("part-0")]
    (path / names[0]).write_text("changed")
    (path / f".{names[0]}.crc").unlink()  # the local file system's own check
    (path / names[1]).unlink()
    (path / "part-99999-own.txt").write_text("x")
    assert {r["name"]: r["problem"] for r in export.damaged_parts(spark, str(path)).collect()} == {names[0]: "changed", names[1]: "missing", "part-99999-own.txt": "unknown"}


def test_json_parts_are_the_small_writer_s_file(spark, tricky, tmp_path):
    path, small = str(tmp_path / "json"), str(tmp_path / "small.json")
    some = tricky.filter("k < 60")
    export.ordered_json(some, path, ["k"], ["k", "said", "flag"])
    writers.json_list_file(some, small, ["k"], ["k", "said", "flag"])
    with open(small, "rb") as f:
        assert text_of(spark, path, tmp_path) == f.read()
    none = str(tmp_path / "none")
    export.ordered_json(some.limit(0), none, ["k"])
    assert json.loads(text_of(spark, none, tmp_path)) == []


def test_exports_of_nothing_and_failures_leave_nothing(spark, tricky, tmp_path):
    path = tmp_path / "none"
    export.ordered_csv(tricky.limit(0), str(path), ["k"])
    assert text_of(spark, str(path), tmp_path) == b"\xef\xbb\xbfk,said,x,flag\n"
    assert export.read_csv(spark, str(path), "k long, said string, x double, flag boolean").count() == 0
    with pytest.raises(ValueError):
        export.ordered_csv(tricky.limit(0), str(tmp_path / "must"), ["k"], allow_empty=False)
    with pytest.raises(Exception, match="raise_error|broken"):
        export.ordered_csv(tricky.withColumn("k", F.when(F.col("k") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("k"))), str(tmp_path / "bad"), ["k"])
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("bad")]


def test_large_export_is_read_back_in_order(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("string").alias("l_shipdate"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    path = str(tmp_path / "lines")
    export.ordered_csv(lines, path, order)
    back = export.read_csv(spark, path, "l_orderkey long, l_linenumber long, l_partkey long, l_shipdate string").toPandas().sort_values("place")
    want = lines.toPandas().sort_values(order, kind="stable", ignore_index=True)
    assert len(back) == len(want) > writers.FILE_ROWS and (back["place"].to_numpy() == np.arange(len(want))).all()
    for c in order:
        assert (back[c].to_numpy() == want[c].to_numpy()).all(), c


# image headers


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(x, exif=None):
    raw = np.zeros((x.shape[0], x.shape[1] + 1), np.uint8)
    raw[:, 1:] = x
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)
    return images.PNG + chunk(b"IHDR", head) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def tiff(orientation, end="<", tag=0x0112):
    return (b"II" if end == "<" else b"MM") + struct.pack(end + "HIH", 42, 8, 2) + struct.pack(end + "HHIHH", 0x010F, 2, 1, 0, 0) + struct.pack(end + "HHIHH", tag, 3, 1, orientation, 0) + b"\0" * 4


def jpeg(width, height, exif=None, end=b"\xff\xd9", frame=0xC0):
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0" + b"\0" * 9)
    if exif is not None:
        out += part(0xE1, b"Exif\0\0" + exif)
    return out + b"\xff\xff" + part(frame, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")[1:] + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"\x12\xff\x00\x34" + end


GREY = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
FILES = {
    "plain.png": (png(GREY), ("png", 4, 3, 1, None)), "turned.png": (png(GREY, tiff(6)), ("png", 4, 3, 6, None)), "big.jpg": (jpeg(640, 480), ("jpeg", 640, 480, 1, None)),
    "side.JPG": (jpeg(640, 480, tiff(8, ">")), ("jpeg", 640, 480, 8, None)), "progressive.jpeg": (jpeg(10, 20, frame=0xC2), ("jpeg", 10, 20, 1, None)), "other_tag.jpg": (jpeg(5, 6, tiff(3, tag=0x0100)), ("jpeg", 5, 6, 1, None)),
    "odd.jpg": (jpeg(5, 6, tiff(99)), ("jpeg", 5, 6, 1, None)), "text.jpg": (b"no image", (None, None, None, None, "unknown_format")),
    "cut.png": (png(GREY)[:-20], ("png", None, None, None, "truncated")), "flipped.png": (png(GREY)[:45] + b"\x55" + png(GREY)[46:], ("png", None, None, None, "bad_checksum")),
    "headless.png": (images.PNG + chunk(b"IDAT", b""), ("png", None, None, None, "no_size")), "flat.png": (png(np.zeros((0, 4), np.uint8)), ("png", None, None, None, "no_size")),
    "cut.jpg": (jpeg(5, 6, end=b""), ("jpeg", None, None, None, "truncated")), "short.jpg": (jpeg(5, 6)[:14], ("jpeg", None, None, None, "truncated")), "stop.jpg": (b"\xff\xd8\xff\xd9", ("jpeg", None, None, None, "no_size")),
    "marker.jpg": (b"\xff\xd8\x00\x01", ("jpeg", None, None, None, "bad_marker")), "exif.jpg": (jpeg(5, 6, b"XX"), ("jpeg", None, None, None, "bad_exif")), "exif2.jpg": (jpeg(5, 6, tiff(6)[:20]), ("jpeg", None, None, None, "bad_exif")),
}


def test_headers_and_kinds_of_error(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    found = images.headers(readers.scan_files(spark, str(tmp_path), content=True))
    rows = {r["filename"]: r for r in found.collect()}
    assert {n: (r["format"], r["width"], r["height"], r["orientation"], r["error"]) for n, r in rows.items()} == {n: want for n, (_, want) in FILES.items()}
    assert (rows["side.JPG"]["upright_width"], rows["side.JPG"]["upright_height"]) == (480, 640) and rows["big.jpg"]["upright_width"] == 640
    assert images.header(None)[-1] == images.header(b"")[-1] == "empty"
    reasons = {r["path"].rsplit("/", 1)[1]: r["review_reason"] for r in images.decode_errors(found).collect()}
    assert reasons["cut.png"] == "decode_error:truncated" and len(reasons) == sum(w[-1] is not None for _, w in FILES.values())


def test_every_prefix_of_a_file_is_an_error_not_a_failure():
    for data in (png(GREY, tiff(6)), jpeg(64, 48, tiff(3, ">"))):
        assert images.header(data)[-1] is None
        assert all(images.header(data[:n])[-1] for n in range(len(data)))
    rng = random.Random(2)
    for _ in range(3000):
        data = bytearray(rng.choice([png(GREY, tiff(5)), jpeg(64, 48, tiff(3))]))
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        images.header(bytes(data))


def test_turned_pixels(spark, tmp_path):
    x = np.array([[1, 2, 3], [4, 5, 6]])
    upright = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    assert all(pixels.turned(x, o).tolist() == want for o, want in upright.items())
    (tmp_path / "a.png").write_bytes(png(GREY, tiff(6)))
    (tmp_path / "bad.png").write_bytes(b"no")
    found = images.headers(readers.scan_files(spark, str(tmp_path), content=True)).select(F.col("path").alias("p"), "orientation")
    shown = spark.read.format("image").load(str(tmp_path)).withColumn("p", F.regexp_replace("image.origin", "^file:/+", "file:/"))
    rows = shown.join(found, "p").select("p", pixels.upright_rgb("image", "orientation").alias("u")).collect()
    by = {r["p"].rsplit("/", 1)[1]: r["u"] for r in rows}
    assert (by["a.png"]["height"], by["a.png"]["width"]) == (4, 3) and by["bad.png"]["data"] is None
    assert np.frombuffer(by["a.png"]["data"], np.uint8).reshape(4, 3, 3)[:, :, 0].tolist() == GREY.T[:, ::-1].tolist()


# learning


def plain_fit(x, y, weight, c):
    """Softmax regression by plain gradient descent with halved steps."""
    z = np.hstack((np.ones((len(x), 1)), (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)))
    classes = np.unique(y)
    hot = (y[:, None] == classes).astype(float)
    ridge = np.append(0, np.full(x.shape[1], 1 / c))
    w, step = np.zeros((len(classes), z.shape[1])), 1e-3

    def loss(w):
        s = z @ w.T
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        return -(weight * np.log((p * hot).sum(axis=1))).sum() + (ridge * w * w).sum() / 2, ((p - hot) * weight[:, None]).T @ z + ridge * w

    value, g = loss(w)
    for _ in range(20_000):
        new = w - step * g
        after, h = loss(new)
        if after <= value:
            w, value, g, step = new, after, h, step * 1.3
        else:
            step /= 2
        if np.abs(g).max() < 1e-6:
            break
    return classes, w, x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)


@pytest.mark.parametrize("weights", ["none", "balanced", 0.25])
def test_folds_together_equal_one_by_one(spark, weights):
    rng = np.random.default_rng(5)
    y = rng.choice([0, 1, 3], p=[0.7, 0.2, 0.1], size=240)
    x = rng.normal(size=(240, 5)) + y[:, None] * np.array([0.5, -0.3, 0, 0.2, 0])
    x[:, 4] = 2.5  # a constant feature
    fold = np.arange(240) % 3
    y[fold == 1] = np.where(y[fold == 1] == 3, 0, y[fold == 1])
    rows = spark.createDataFrame([(i, int(f), int(t), [float(v) for v in r]) for i, (f, t, r) in enumerate(zip(fold, y, x, strict=True))], "id long, fold int, true_id int, features array<double>")
    found = {r["id"]: r for r in learn.out_of_fold(rows.repartition(5), 5, weights).collect()}
    for f in range(3):
        train = fold != f
        n = np.bincount(y[train], minlength=5)
        known = n[n > 0]
        per = {"none": np.ones(5), "balanced": train.sum() / (len(known) * np.maximum(n, 1)), 0.25: np.maximum(n, 1.0) ** -0.25}[weights]
        classes, w, mean, scale = plain_fit(x[train], y[train], per[y[train]], 1.0)
        s = np.hstack((np.ones(((~train).sum(), 1)), (x[~train] - mean) / scale)) @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, want in zip(np.flatnonzero(~train), p, strict=True):
            full = np.zeros(5)
            full[classes] = want
            assert np.allclose(found[i]["probs"], full, atol=2e-4) and found[i]["pred_id"] == np.argmax(found[i]["probs"])


def test_regressions_of_awkward_rows(spark):
    schema = "id long, fold int, true_id int, features array<double>"
    one = spark.createDataFrame([(i, 0, i % 2, [float(i)]) for i in range(6)], schema)
    assert learn.out_of_fold(one, 2).count() == 0
    assert learn.out_of_fold(one.limit(0), 2).count() == 0
    single = spark.createDataFrame([(i, i % 2, 1, [float(i), 1.0]) for i in range(6)], schema)
    assert {(r["pred_id"], tuple(r["probs"])) for r in learn.out_of_fold(single, 3).collect()} == {(1, (0.0, 1.0, 0.0))}


def test_throughput_by_fold(spark):
    import time

    rows = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("fold"))

    def load():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            time.sleep(0.01)
            return batch.assign(score=batch["id"] * 2.0)

        return run

    meter = learn.Throughput([0, 1, 2, 7])
    done = meter.scored(rows, load, "id long, fold int, score double")
    assert done.columns == ["id", "fold", "score"]
    assert sorted(r["score"] for r in done.collect()) == [2.0 * i for i in range(300)]
    table = {r["fold"]: r for r in meter.table(spark).collect()}
    assert {f: r["rows"] for f, r in table.items()} == {0: 100, 1: 100, 2: 100, 7: 0}
    assert sum(r["task_seconds"] for r in table.values()) >= 0.01 and table[7]["task_seconds"] == 0
    assert all(r["rows_per_second"] == pytest.approx(r["rows"] / r["wall_seconds"]) for r in table.values())
