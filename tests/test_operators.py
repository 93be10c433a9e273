"""Operators on small literal inputs, with edge cases and invariants."""

import pytest
from pyspark.sql import functions as F

from labelyard.functions import names, vectors
from labelyard.operators import duplicates, folds, graph, manifest, metrics, postproc, review, service, validate

CONFUSION = [[24, 0, 0, 0, 0, 0], [0, 0, 0, 1, 3, 0], [0, 0, 22, 1, 0, 0], [0, 0, 0, 56, 4, 0], [0, 0, 0, 2, 1019, 0], [0, 0, 1, 0, 6, 0]]


def test_recorded_confusion(spark):
    rows = [(t, p, n) for t, r in enumerate(CONFUSION) for p, n in enumerate(r) if n]
    counts = spark.createDataFrame(rows, "true_id int, pred_id int, n long")
    got = metrics.summary(metrics.per_class(counts, 6), "nanmean").first()
    assert got["rows"] == 1139
    assert got["accuracy"] == pytest.approx(0.9841966637)
    assert got["weighted_f1"] == pytest.approx(0.9794031475)
    assert got["macro_f1"] == pytest.approx(0.6470914486)
    assert got["balanced_accuracy"] == pytest.approx(0.6479827014)
    assert got["miou"] == pytest.approx(0.6295266495)


def test_iou_rules_differ(spark):
    counts = spark.createDataFrame([(0, 0, 5), (0, 1, 1)], "true_id int, pred_id int, n long")
    got = [metrics.summary(metrics.per_class(counts, 3), r).first()["miou"] for r in metrics.IOU_RULES]
    assert got == pytest.approx([(5 / 6) / 2, (5 / 6) / 3, 5 / 6])


def test_metrics_of_nothing(spark):
    counts = spark.createDataFrame([], "true_id int, pred_id int, n long")
    got = metrics.summary(metrics.per_class(counts, 3), "nanmean").first()
    assert got["rows"] == 0 and got["accuracy"] is None and got["miou"] is None


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.argmax("v")).collect()] == [1, 0]


def test_names(spark):
    df = spark.createDataFrame([("12.jpg", "a/test/train/x"), ("x1.jpg", "val/y"), ("1.2.jpg", "training/z"), (None, None)], "n string, p string")
    got = df.select(names.filename_number("n"), names.infer_split("p")).collect()
    assert [r[0] for r in got] == [12, None, None, None]
    assert [r[1] for r in got[:3]] == ["train", "val", "unknown"]


def test_components_any_edge_order(spark):
    chain = [(i, i + 1) for i in range(12)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    want = {i: 0 for i in range(13)} | {100: 100, 101: 100, 102: 100}
    for edges in (chain, [(b, a) for a, b in chain[::-1]]):
        got = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r[0]: r[1] for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([(i,) for i in range(999, -1, -1)], "k long")
    got = {r["k"]: r["position"] for r in manifest.positions(df, "k").collect()}
    assert got == {i: i for i in range(1000)}


def test_sequence_blocks_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "FRAMES", 4)
    frames = [0, 1, 2, 3, 4, 5, 9, 10, 30, 31, 31, None]
    df = spark.createDataFrame([(f,) for f in frames], "frame_id long")
    got = sorted((r["frame_id"] if r["frame_id"] is not None else -1, r["sequence_id"]) for r in manifest.sequence_blocks(df).collect())
    number = {-1: "file_block_unknown", **{f: "file_block_0000" for f in range(6)}, 9: "file_block_0001", 10: "file_block_0001", 30: "file_block_0002", 31: "file_block_0002"}
    assert got == sorted((f if f is not None else -1, number[f if f is not None else -1]) for f in frames)


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"d{i % 2}", rng.choice([None, *range(30)]), f"s{i % 40}", rng.getrandbits(3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, dir string, frame long, sha256 string, hash long")
    got = {(r["left_id"], r["right_id"]) for r in duplicates.near_pairs(df, 3, 1).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] is not None and b[2] is not None and a[3] != b[3] and (0 < b[2] - a[2] <= 3 or (a[2] == b[2] and a[0] < b[0])) and (a[4] ^ b[4]).bit_count() <= 1:
                want.add((a[0], b[0]))
    assert got == want


def test_group_folds(spark):
    rows = spark.createDataFrame([(g, g % 3) for g in range(60) for _ in range(3)], "g long, y int")
    dealt = folds.group_folds(rows, "g", "y", 3)
    assert dealt.count() == 60 and dealt.select("g").distinct().count() == 60
    n = rows.join(dealt, "g").groupBy("fold", "y").count().collect()
    assert len(n) == 12 and {r["count"] for r in n} == {15}
    with pytest.raises(ValueError):
        folds.group_folds(rows.filter("g < 2"), "g", "y", 3)
    with pytest.raises(ValueError):
        folds.sequence_groups(rows, "g")


def test_support_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(n, i, f"{i}") for n in (3, 4, 5, 10) for i in range(n)], "group_id long, frame long, filename string")
    got = {r["group_id"]: r["n"] for r in postproc.support_split(rows, 0.5).filter("is_support").groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    assert got == {4: 2, 5: 2, 10: 5}


def test_early_stop(spark):
    h = spark.createDataFrame([(1, e, m) for e, m in enumerate([0.1, 0.3, 0.2, 0.3, 0.2, 0.9])], "run int, epoch long, m double")
    got = [(r["improved"], r["stale"], r["stopped"]) for r in postproc.early_stop(h, "run", "epoch", "m", 3).orderBy("epoch").collect()]
    assert got == [(True, 0, False), (True, 0, False), (False, 1, False), (False, 2, False), (False, 3, False), (True, 0, True)]


def test_validators(spark):
    df = spark.createDataFrame([("a", [0.5, 0.5]), ("a", [0.9, 0.2]), ("b", [float("nan"), 1.0]), ("c", None)], "k string, p array<double>")
    assert [tuple(r) for r in validate.duplicate_keys(df, "k").collect()] == [("a", 2)]
    assert validate.simplex_violations(df, "p", 2).count() == 3
    with pytest.raises(ValueError):
        validate.require(df, "any row")
    with pytest.raises(ValueError):
        validate.require_rows(df.limit(0))
    with pytest.raises(ValueError):
        validate.require_columns(df, ["z"])


def test_positional_diff(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "position long, f string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "position long, f string")
    assert sorted(tuple(r) for r in review.positional_diff(a, b, "position", ["f"]).collect()) == [(1, "f"), (2, "f")]


def test_first_decision_stands(spark):
    acts = spark.createDataFrame([("A", "reject", 1, " "), ("A", "confirm", 2, None), ("A", "reject", 3, "no"), ("B", "later", 1, "x")], "alert_id string, action string, ts long, reason string")
    assert [tuple(r)[:2] for r in service.first_decisions(acts).collect()] == [("A", "confirm")]


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a long, b string")
    one = manifest.digest(df, "a", "b").first()[0]
    assert one == manifest.digest(df.orderBy(F.desc("a")), "a", "b").first()[0] != manifest.digest(df.filter("a > 0"), "a", "b").first()[0]


def test_digest_counts_equal_rows_and_tells_nulls(spark):
    make = lambda *rows: manifest.digest(spark.createDataFrame(list(rows), "a string, b string"), "a", "b").first()[0]
    cases = [[("x", "y")], [("x", "y")] * 2, [("xy", "")], [("", "xy")], [("xy", None)], [(None, "xy")], [("-", "xy")]]
    assert len({make(*c) for c in cases}) == len(cases)


def test_refused_updates(spark):
    df = spark.createDataFrame([("a", "pending"), ("b", "lost"), ("c", None)], "order_id string, status string")
    assert sorted(r["order_id"] for r in service.refused(df).collect()) == ["b", "c"]
