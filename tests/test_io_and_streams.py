"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from labelyard.sources import readers, writers
from labelyard.streaming import alerts


def test_csv_with_mark_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿filename,label\nx.jpg,"a ""b"",\nc"\n,blank\nx.jpg,last\n', encoding="utf-8")
    df = readers.csv_table(spark, str(tmp_path / "a.csv"), "filename string, label string")
    assert df.first().asDict() == {"filename": "x.jpg", "label": 'a "b",\nc'}
    kept = readers.keyed_manifest(spark, str(tmp_path / "a.csv"), "filename string, label string")
    assert [tuple(r) for r in kept.collect()] == [("x.jpg", "last")]


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("d/a.JPG", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    files = readers.scan_files(spark, str(tmp_path), content=True)
    assert sorted(r["filename"] for r in readers.unique_files(files).collect()) == ["a.JPG", "b.png"]
    assert readers.digests(files).filter("length(sha256) = 64").count() == 2
    (tmp_path / "A.jpg").write_bytes(b"x")
    with pytest.raises(ValueError):
        readers.unique_files(readers.scan_files(spark, str(tmp_path)))


def test_json(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps([{"filename": "a", "width": 1, "height": 2, "label": "x"}, {"filename": "b", "label": "y"}]))
    assert readers.json_labels(spark, str(p), ("x", "y")).count() == 2
    with pytest.raises(ValueError):
        readers.json_labels(spark, str(p), ("x",))
    assert [tuple(r) for r in readers.json_list(spark, str(p), "filename:string").orderBy("position").collect()] == [(0, "a"), (1, "b")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "有"), ("a", "x")], "filename string, label string")
    writers.json_list_file(df, str(tmp_path / "o.json"), ["filename"], ["filename", "label"])
    text = (tmp_path / "o.json").read_text(encoding="utf-8")
    assert text.endswith("]\n") and "有" in text and [r["filename"] for r in json.loads(text)] == ["a", "b"]
    writers.csv_file(df, str(tmp_path / "o.csv"), ["filename"])
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbffilename,label")
    writers.csv_file(df, str(tmp_path / "p.csv"), ["filename"], ["label"])
    assert (tmp_path / "p.csv").read_text(encoding="utf-8-sig").split() == ["label", "x", "有"]
    assert len(writers.sidecar(str(tmp_path / "o.csv"))) == 64
    with pytest.raises(ValueError):
        writers.csv_dataset(df.limit(0), str(tmp_path / "e"), ["filename"], allow_empty=False)


def test_probability_columns(spark):
    df = spark.createDataFrame([("f", [0.25, 0.75])], "filename string, probs array<double>")
    wide = writers.prediction_columns(df, ["a", "b"])
    assert wide.first()["prob_b"] == "0.750000000"
    assert writers.probability_array(wide, ["a", "b"]).first()["probs"] == [0.25, 0.75]


def test_fold_predictions(spark):
    df = spark.createDataFrame([("f", 2, 0, 1, [1.0, 2.0], [0.25, 0.75])], "filename string, fold int, true_id int, pred_id int, logits array<double>, probs array<double>")
    row = writers.fold_predictions(df, ["a", "b"]).first().asDict()
    assert row == {"filename": "f", "fold": 2, "true_label_id": 0, "true_label": "a", "pred_label_id": 1, "pred_label": "b", "logit_a": 1.0, "logit_b": 2.0, "prob_a": 0.25, "prob_b": 0.75}


def test_geometries_keep_their_coordinates(spark, tmp_path):
    shapes = [{"type": "Point", "coordinates": [1.5, 2]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, None]
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"k": str(i)}} for i, g in enumerate(shapes)]}))
    got = readers.geojson_features(spark, str(path)).collect()
    assert [r["geometry"] and json.loads(r["geometry"]) for r in got] == shapes


def test_paths_of_names_and_folded_case(spark):
    files = spark.createDataFrame([("/b/x.jpg", "x.jpg"), ("/a/x.jpg", "x.jpg"), ("/c/y.jpg", "y.jpg")], "path string, filename string")
    got = sorted((r["filename"], r["rank"], r["rank_n"], r["path"]) for r in readers.paths_of_names(files).collect())
    assert got == [("x.jpg", 1, 2, "/a/x.jpg"), ("x.jpg", 2, 2, "/b/x.jpg"), ("y.jpg", 1, 1, "/c/y.jpg")]
    with pytest.raises(ValueError):
        readers.unique_files(spark.createDataFrame([("/a", "Straße"), ("/b", "STRASSE")], "path string, filename string"))


def test_scene_groups(spark, tmp_path):
    (tmp_path / "g.csv").write_text("filename,scene_group\na,s1\nb,s2\n")
    assert readers.scene_groups(spark, str(tmp_path / "g.csv"), "filename string, scene_group string").count() == 2
    (tmp_path / "h.csv").write_text("filename,scene_group\na,s1\nb, \n")
    with pytest.raises(ValueError):
        readers.scene_groups(spark, str(tmp_path / "h.csv"), "filename string, scene_group string")


def test_upsert_reads_near_days_only(spark, tmp_path):
    path = str(tmp_path / "alerts")
    for k, rows in enumerate([[("1", "2024-01-01"), ("2", "2024-01-02"), ("3", None)], [("1", "2024-01-05"), ("1", "2024-03-01"), ("4", "2024-01-05"), ("3", None)]]):
        batch = spark.createDataFrame([(i, "c", 0.5, t) for i, t in rows], "detection_id string, category string, confidence double, t string").withColumn("ts", F.to_timestamp("t"))
        alerts.upsert_alerts(batch, k, path)
    got = sorted((r["alert_id"], str(r["day"])) for r in spark.read.parquet(path).collect())
    assert got == [("ALT-1", "2024-01-01"), ("ALT-2", "2024-01-02"), ("ALT-3", "None"), ("ALT-4", "2024-01-05")]


def _run(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ingest_once(spark, tmp_path):
    for k, ids in enumerate([[1, 2, 2], [2, 3]]):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"detection_id": str(i), "category": "c", "confidence": 0.5, "observed_at": "2024-01-01T00:00:00"}) for i in ids))
    got = _run(spark, alerts.ingest(alerts.read_detections(spark, str(tmp_path), files=1)), "append", "ingested")
    assert sorted(r["alert_id"] for r in got.collect()) == ["ALT-1", "ALT-2", "ALT-3"]


def test_decisions_and_windows(spark, tmp_path):
    rows = [("A", "confirm", "2024-01-01 00:01:00", None, 1.0), ("A", "reject", "2024-01-01 00:02:00", "no", 2.0), ("B", "reject", "2024-01-01 00:20:00", " ", 4.0), ("C", "view", "2024-01-01 05:00:00", None, 0.0)]
    df = spark.createDataFrame(rows, "alert_id string, action string, t string, reason string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "acts"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "acts"))
    assert [(r["alert_id"], r["status"]) for r in _run(spark, alerts.decisions(stream), "append", "decided").collect()] == [("A", "confirmed")]
    got = _run(spark, alerts.counts(stream), "append", "windows")
    assert sorted((r["n"], r["total"]) for r in got.collect()) == [(1, 4.0), (2, 3.0)]
