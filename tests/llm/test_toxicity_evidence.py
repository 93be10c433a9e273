"""Thresholds of the toxicity classifier need evidence, by language and at the smallest size."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

from labelyard.llm import queries, toxicity  # noqa: E402


def test_scores_that_separate_nothing_give_no_threshold():
    rng = np.random.default_rng(3)
    p, y = 0.38 + rng.random(80) / 1000, (np.arange(80) % 13 == 0).astype(float)
    t = toxicity.best_threshold(p, y)
    assert (p >= t).sum() == 0
    p[y == 1] += 0.2
    t = toxicity.best_threshold(p, y)
    assert ((p >= t) == (y == 1)).all()


def test_one_hit_is_no_evidence():
    p, y = np.array([0.9, *[0.2] * 60]), np.array([1.0, *[0.0] * 60])
    assert toxicity.best_threshold(p, y) > 0.9
    p, y = np.concatenate((p, [0.91, 0.92, 0.93])), np.concatenate((y, [1.0] * 3))
    assert 0.2 < toxicity.best_threshold(p, y) < 0.9


def test_languages_get_thresholds_of_their_own():
    counts = np.zeros(toxicity.COUNTS)
    for lang, at in ((1, 3000), (2, 1500)):
        counts[lang, 1, at : at + 40] = 10
        counts[lang, 0, at - 1000 : at - 5] = 3
    t = toxicity.thresholds(counts)
    assert t[2] < 1500 / toxicity.SCORE_BINS < 2000 / toxicity.SCORE_BINS < t[1] < 3000 / toxicity.SCORE_BINS


def test_filter_of_labelled_ids(spark):
    known = spark.createDataFrame([(i * 7,) for i in range(500)], "doc_id long")
    bits = toxicity.id_filter(known)
    assert bits.nbytes * 8 == toxicity.FILTER_BITS
    assert 490 <= sum(int(b).bit_count() if b >= 0 else int(b + 2**64).bit_count() for b in bits.tolist()) <= 500
    assert not toxicity.id_filter(known.limit(0)).any()


def test_tasks_train_what_the_driver_trains(spark):
    texts = [(b"vile words " if i % 3 == 0 else b"kind words ") * 5 for i in range(40)]
    ids = [toxicity.buckets([t])[0] for t in texts]
    y = np.array([float(i % 3 == 0) for i in range(40)])
    rows = spark.createDataFrame(pd.DataFrame({"ids": [i.astype("<u2").tobytes() for i in ids], "y": y.astype(int), "place": range(40)}), "ids binary, y int, place long")
    for a, b in zip(toxicity.trained_in_tasks(rows.repartition(3)), toxicity.Model(ids, y).nets, strict=True):
        assert all(np.allclose(p, q, atol=1e-5) for p, q in zip(a.params(), b.params(), strict=True))


def test_few_clean_documents_are_toxic_by_language(spark, data):
    """Where 5 of 51 labelled rows are toxic, most clean rows stay, in every language."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op2_toxicity(spark, data).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("toxic = 0").toPandas()
    assert (rows.groupby("lang")["predicted"].mean() < 0.15).all()
