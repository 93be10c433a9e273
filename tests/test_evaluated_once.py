"""Expressions on arrays evaluate what they share once."""

import math

from pyspark.sql import functions as F

from labelyard.functions import vectors
from labelyard.operators import validate
from labelyard.plans import evaluation


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prob_simplex_reads_the_json_once_where_its_filter_is_pushed(spark, data):
    plan = optimized(evaluation.prob_simplex(spark, data))
    assert plan.count("get_json_object") == 1


def test_softmax_and_length_are_evaluated_once(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0],), ([0.0, 0.0, 0.0],), ([],), (None,)], "v array<double>")
    for f in (vectors.softmax, vectors.normalized):
        assert optimized(rows.select(f(F.transform("v", lambda x: F.cbrt(x))).alias("p"))).lower().count("cbrt") == 1
    soft, unit = zip(*rows.select(vectors.softmax("v"), vectors.normalized("v")).collect(), strict=True)
    e = [math.exp(x - 4) for x in (1, 2, 4)]
    assert soft[0] == [x / sum(e) for x in e] and soft[1] == [1 / 3] * 3 and soft[2] == [] and soft[3] is None
    assert unit[0] == [x / math.sqrt(21) for x in (1, 2, 4)] and unit[1] == [None] * 3 and unit[2] == [] and unit[3] is None


def test_simplex_violations_of_odd_rows(spark):
    good = [[0.5, 0.5], [1.0, 0.0]]
    bad = [None, [], [1.0], [0.5, None], [math.nan, 1.0], [1.5, -0.5], [0.5, 0.4], [math.inf, 0.0]]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "id int, p array<double>")
    assert sorted(r["id"] for r in validate.simplex_violations(rows, "p", 2).collect()) == list(range(2, 10))
