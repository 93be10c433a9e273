"""Case folding, frame numbers, passthrough versions and whole model manifests."""

import copy

import pytest
from pyspark.sql import functions as F

from labelyard.functions import names
from labelyard.operators import review
from labelyard.sources import config, readers


def test_full_case_folding(spark):
    said = ["Straße", "STRASSE", "ﬁle", "FILE", "ΣΊΣΥΦΟΣ", "σίσυφος", "İx", "ǰ", None, ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, filename string")
    got = {r["i"]: r["f"] for r in rows.select("i", readers.folded("filename").alias("f")).collect()}
    assert got == {i: None if s is None else s.casefold() for i, s in enumerate(said)}
    files = spark.createDataFrame([("/a", "ﬁle.jpg"), ("/b", "FILE.jpg")], "path string, filename string")
    with pytest.raises(ValueError):
        readers.unique_files(files)
    files = spark.createDataFrame([("/a", "b.jpg"), ("/b", "A.jpg"), ("/c", "Ç.jpg")], "path string, filename string")
    assert [r["filename"] for r in readers.unique_files(files).collect()] == ["A.jpg", "b.jpg", "Ç.jpg"]


def test_frame_numbers_or_failure(spark):
    rows = spark.createDataFrame([("7", "x.jpg"), (None, "d/0042.jpg"), (" 5 ", "9.jpg"), ("", "12"), ("-3", "q")], "frame string, name string")
    assert [r[0] for r in rows.select(names.frame_number(F.col("frame"), F.col("name"))).collect()] == [7, 42, 5, 12, -3]
    for bad in [(None, "a1.jpg"), ("x", "y.jpg"), (None, None)]:
        with pytest.raises(Exception, match="no frame number"):
            spark.createDataFrame([bad], rows.schema).select(names.frame_number(F.col("frame"), F.col("name"))).collect()


def test_passthrough_changes_nothing(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "filename string, label string")
    decisions = spark.createDataFrame([("a", "y"), ("b", "y"), ("z", "x")], "filename string, reviewed_label string")
    rows, audit = review.passthrough(labels, decisions, "v1")
    assert sorted(map(tuple, rows.collect())) == [("a", "x", "v1"), ("b", "y", "v1"), ("c", "x", "v1")]
    assert tuple(audit.first()) == ("v1", 3, 2, 1, 0)
    assert tuple(review.passthrough(labels.limit(0), decisions, "v1")[1].first()) == ("v1", 0, 0, 0, 0)


MANIFEST = {
    "labels": ["p", "q"], "model": {"architecture": "net", "input_size": 448, "mean": [0.485, 0.456], "interpolation": "Bicubic"}, "ensemble": {"fold_count": 2, "method": "mean", "weights": [0.25, 0.75]},
    "checkpoints": [{"fold": k, "path": f"m/{k}.bin", "sha256": "ab" * 32} for k in range(2)],
}
MODEL = {"architecture": "net", "input_size": 448, "mean": (0.485, 0.456), "interpolation": "bicubic"}


def test_whole_manifests():
    members = config.check_manifest(MANIFEST, ["p", "q"], MODEL, ["mean", "weighted"])
    assert [(m["fold"], m["weight"]) for m in members] == [(0, 0.25), (1, 0.75)]


@pytest.mark.parametrize("path, value", [
    (["labels"], ["q", "p"]), (["labels"], None), (["model"], []), (["model", "architecture"], "other"), (["model", "input_size"], "448"), (["model", "input_size"], True), (["model", "mean"], [0.485]), (["model", "mean"], [0.485, 0.457]),
    (["model", "interpolation"], None), (["ensemble"], None), (["ensemble", "method"], "vote"), (["ensemble", "fold_count"], 3), (["ensemble", "weights"], [0.5, 0.6]), (["ensemble", "weights"], [-0.5, 1.5]), (["ensemble", "weights"], [1.0]),
    (["checkpoints"], []), (["checkpoints", 0], "x"), (["checkpoints", 0, "fold"], 1), (["checkpoints", 1, "path"], "../x"), (["checkpoints", 1, "path"], ""), (["checkpoints", 1, "sha256"], "ab"),
])
def test_broken_manifests(path, value):
    broken = copy.deepcopy(MANIFEST)
    at = broken
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    with pytest.raises(ValueError):
        config.check_manifest(broken, ["p", "q"], MODEL, ["mean"])
    with pytest.raises(ValueError):
        config.check_manifest([], ["p", "q"], MODEL, ["mean"])
