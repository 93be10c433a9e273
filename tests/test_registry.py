"""Every registered query with SQL against DuckDB on the smallest tables."""

import ast
import datetime
import decimal
import os
import subprocess
import sys

import duckdb
import pytest

from labelyard.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, data, duck):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*[df[c] for c in columns]).collect()), key=repr)
    result = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(name, spark, data):
    assert registry.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_as_many_draws_as_rows(size, spark):
    d = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{d}/events.parquet").count()
    assert sum(r["draws"] for r in registry.queries()["weighted_sample"](spark, d).collect()) == pytest.approx(rows, rel=0.05)


def test_every_error_has_its_place(spark, data):
    rows = registry.queries()["review_orders"](spark, data).collect()
    summary = registry.queries()["error_summary"](spark, data).first()
    at = {}
    for r in rows:
        at.setdefault(r["report"], []).append(r["position"])
    assert summary["errors"] > 50
    assert {k: sorted(v) for k, v in at.items()} == {k: list(range(1, n + 1)) for k, n in (("low_confidence", summary["rows"]), ("small_margin", summary["rows"]), ("high_confidence_errors", summary["errors"]))}


def test_both_random_baselines(spark, data):
    rows = registry.queries()["prior_random"](spark, data).collect()
    folds = {b: sorted(r["fold"] for r in rows if r["baseline"] == b) for b in ("train_prior_random", "uniform_random")}
    assert folds["train_prior_random"] == folds["uniform_random"] and 2 * len(folds["uniform_random"]) == len(rows) > 0
    n = {b: sum(r["rows"] for r in rows if r["baseline"] == b) for b in folds}
    assert n["train_prior_random"] == n["uniform_random"] == spark.read.parquet(f"{data}/events.parquet").count()


@pytest.mark.parametrize("blocked", ["regex", "labelyard.llm", "corpus_pipeline"])
def test_core_queries_without_what_the_others_need(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(sorted(e.queries())); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert set(registry.queries()) <= set(ast.literal_eval(done.stdout))
