"""Queries on predictions: metrics, post-processing grids, baselines, sampling, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, vectors
from ..operators import metrics as M
from ..operators import postproc as P
from ..operators.learn import moments, out_of_fold
from ..operators.manifest import positions
from ..operators.persist import cut
from ..operators.sampling import weighted_sample as weighted_sample_of
from .fixtures import CLASS_SQL, LABELS, MAJORITY, PRED2_SQL, PRED_SQL, pred, pred2, sql, table

N = len(LABELS)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


COUNTS = "counts AS (SELECT true_id, pred_id, count(*) AS n FROM pred GROUP BY ALL)"


def class_sql(keys: str = "", source: str = "counts") -> str:
    return f"""cls AS (SELECT *, tp / greatest(predicted, 1) AS precision, tp / greatest(support, 1) AS recall, CASE WHEN support + predicted - tp > 0 THEN tp / (support + predicted - tp) END AS iou FROM (
  SELECT {keys} class_id, sum(CASE WHEN true_id = class_id THEN n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN pred_id = class_id THEN n ELSE 0 END)::BIGINT AS predicted,
    sum(CASE WHEN pred_id = class_id AND true_id = class_id THEN n ELSE 0 END)::BIGINT AS tp FROM {source}, class GROUP BY ALL)),
clsf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM cls)"""


IOU_SQL = {"nanmean": "avg(iou)", "zerofill": "avg(coalesce(iou, 0))", "present": "avg(CASE WHEN support > 0 THEN iou END)"}


def metric_sql(rule: str, keys: str = "") -> str:
    return f"""SELECT {keys} sum(support)::BIGINT AS rows, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1), 6) AS macro_f1,
  round(avg(recall), 6) AS balanced_accuracy, round({IOU_SQL[rule]}, 6) AS miou FROM clsf GROUP BY ALL"""


def scores_sql(*views: str, source: str, keys: str, rule: str = "nanmean") -> str:
    """Metrics by keys of a view with true_id and pred_id."""
    return sql(*views, CLASS_SQL, f"counts AS (SELECT {keys} true_id, pred_id, count(*) AS n FROM {source} GROUP BY ALL)", class_sql(keys), body=metric_sql(rule, keys))


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, class_sql(), body=metric_sql("nanmean")))
def metrics_nanmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(pred(spark, sf_dir), N, "nanmean"))


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, class_sql(), body=metric_sql("zerofill")))
def metrics_zerofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(pred(spark, sf_dir), N, "zerofill"))


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, class_sql(), body=metric_sql("present")))
def metrics_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(pred(spark, sf_dir), N, "present"))


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, body="SELECT t.class_id AS true_id, p.class_id AS pred_id, coalesce(n, 0)::BIGINT AS n FROM class t CROSS JOIN class p LEFT JOIN counts c ON c.true_id = t.class_id AND c.pred_id = p.class_id"))
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_full(M.confusion(pred(spark, sf_dir)), N)


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, body="SELECT class_id AS true_id, " + ", ".join(f"coalesce(sum(CASE WHEN pred_id = {i} THEN n END), 0)::BIGINT AS pred_{x}" for i, x in enumerate(LABELS)) + " FROM class LEFT JOIN counts ON true_id = class_id GROUP BY class_id"))
def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(M.confusion(pred(spark, sf_dir)), LABELS)


@query(sql(PRED_SQL, CLASS_SQL, COUNTS, class_sql(), body="SELECT class_id, support, predicted, tp, predicted - tp AS fp, support - tp AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM clsf"))
def per_class_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.per_class(M.confusion(pred(spark, sf_dir)), N))


@query(sql(PRED_SQL, CLASS_SQL, body="SELECT class_id, count(p.pred_id) AS n, round(count(p.pred_id) / (SELECT count(*) FROM pred), 6) AS share FROM class LEFT JOIN pred p ON p.pred_id = class_id GROUP BY class_id"))
def pred_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.prediction_distribution(pred(spark, sf_dir), N))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS prior FROM events GROUP BY 1")
def class_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = label_counts(spark, sf_dir)
    return M.rounded(n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("size")))).select("label", "n", (F.col("n") / F.col("size")).alias("prior")))


@query(sql(PRED_SQL, body=f"SELECT event_id, true_id, {str(list(LABELS))}[true_id + 1] AS label FROM pred"))
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("event_id", "true_id", names.decode(F.col("true_id"), LABELS).alias("label"))


ENRICH_SQL = "e AS (SELECT *, probs[true_id + 1] AS true_prob, probs[pred_id + 1] AS pred_prob, list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS margin, true_id <> pred_id AS is_error FROM pred)"
ENRICH_COLUMNS = "filename, fold, true_id, pred_id, round(true_prob, 6) AS true_prob, round(pred_prob, 6) AS pred_prob, round(margin, 6) AS margin, is_error"


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.enriched(pred(spark, sf_dir)).select("filename", "fold", "true_id", "pred_id", "true_prob", "pred_prob", "margin", "is_error"))


@query(sql(PRED_SQL, ENRICH_SQL, body=f"SELECT {ENRICH_COLUMNS} FROM e"))
def oof_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir)


@query(sql(PRED_SQL, ENRICH_SQL, body=f"SELECT {ENRICH_COLUMNS} FROM e WHERE true_id <> {MAJORITY}"))
def minority_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).filter(F.col("true_id") != MAJORITY)


@query(sql(PRED_SQL, ENRICH_SQL, body=f"SELECT {ENRICH_COLUMNS} FROM e WHERE is_error ORDER BY round(pred_prob, 6) DESC, filename LIMIT 50"))
def high_conf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 errors with the largest confidence; ``review_orders`` has all of them."""
    return _enriched(spark, sf_dir).filter("is_error").orderBy(F.desc("pred_prob"), "filename").limit(50)


ORDERS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS report, row_number() OVER (ORDER BY {order}, filename) AS position, {ENRICH_COLUMNS} FROM e{where}"
    for name, order, where in (("low_confidence", "round(pred_prob, 6)", ""), ("small_margin", "round(margin, 6)", ""), ("high_confidence_errors", "round(pred_prob, 6) DESC", " WHERE is_error"))
)


@query(sql(PRED_SQL, ENRICH_SQL, body=ORDERS_SQL))
def review_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by low confidence and by small margin and all errors by high confidence, each with
    its place (from 1) in its report."""
    rows = cut(_enriched(spark, sf_dir))
    orders = [("low_confidence", rows, F.asc("pred_prob")), ("small_margin", rows, F.asc("margin")), ("high_confidence_errors", rows.filter("is_error"), F.desc("pred_prob"))]
    parts = [positions(some, order, F.asc("filename"), first=1).select(F.lit(name).alias("report"), "position", *rows.columns) for name, some, order in orders]
    return reduce(DataFrame.unionByName, parts)


@query(sql(PRED_SQL, body=f"SELECT count(*) AS rows, count(*) FILTER (WHERE true_id <> pred_id) AS errors, count(*) FILTER (WHERE true_id <> {MAJORITY} AND pred_id = {MAJORITY}) AS minority_as_majority, count(*) FILTER (WHERE true_id = {MAJORITY} AND pred_id <> {MAJORITY}) AS majority_as_minority FROM pred"))
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("true_id"), F.col("pred_id")
    return pred(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(t != p).alias("errors"), F.count_if((t != MAJORITY) & (p == MAJORITY)).alias("minority_as_majority"), F.count_if((t == MAJORITY) & (p != MAJORITY)).alias("majority_as_minority"))


@query(sql(PRED_SQL, body="SELECT fold, filename, true_id, pred_id FROM pred"))
def oof_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the folds' tables."""
    rows = pred(spark, sf_dir).select("fold", "filename", "true_id", "pred_id")
    out = rows.filter("fold = 0")
    for k in (1, 2, 3):
        out = out.unionByName(rows.filter(F.col("fold") == k))
    return out


@query(sql(PRED_SQL, body="SELECT fold, " + ", ".join(f"count(*) FILTER (WHERE true_id = {i}) AS n_{x}" for i, x in enumerate(LABELS)) + " FROM pred GROUP BY fold"))
def fold_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).groupBy("fold").agg(*[F.count_if(F.col("true_id") == i).alias(f"n_{x}") for i, x in enumerate(LABELS)])


@query(sql(PRED_SQL, body=f"SELECT fold, count(*) AS rows, count(DISTINCT group_id) AS n_groups, round(min(w[1] / w[2]), 6) AS min_ratio, round(max(w[1] / w[2]), 6) AS max_ratio, array_to_string(list_filter(range({N}), lambda i: NOT list_contains(list(true_id), i)), ',') AS missing FROM pred GROUP BY fold"))
def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.fold_audit(pred(spark, sf_dir), N, F.get("w", F.lit(0)) / F.get("w", F.lit(1)), "group_id"))


@query(sql(PRED_SQL, CLASS_SQL, f"counts AS (SELECT CASE WHEN grouping(fold) = 1 THEN 'global' ELSE fold::VARCHAR END AS fold, true_id, {MAJORITY} AS pred_id, count(*) AS n FROM pred GROUP BY GROUPING SETS ((fold, true_id), (true_id)))", class_sql("fold,"), body=metric_sql("zerofill", "fold,")))
def baseline_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant baseline for each fold and for all, from one pass."""
    rows = pred(spark, sf_dir).select("fold", "true_id", F.lit(MAJORITY).alias("pred_id"))
    counts = rows.groupingSets([("fold", "true_id", "pred_id"), ("true_id", "pred_id")], "fold", "true_id", "pred_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("fold").alias("g"))
    counts = counts.select(F.when(F.col("g") == 1, "global").otherwise(F.col("fold").cast("string")).alias("fold"), "true_id", "pred_id", "n")
    return M.rounded(M.summary(M.per_class(counts, N, "fold"), "zerofill", "fold"))


UNIFORM_SQL = "(('0x' || substr(md5(filename || ':42'), 1, 8))::BIGINT / 4294967296::DOUBLE)"
BELOW_SQL = "[" + ", ".join(f"count(*) FILTER (WHERE true_id <= {i})" for i in range(N)) + "]"
DRAWN_SQL = f"""drawn AS (SELECT 'train_prior_random' AS baseline, fold, true_id, len(list_filter(below, lambda x: x <= u * below[{N}]))::INT AS pred_id
  FROM (SELECT *, {UNIFORM_SQL} AS u FROM pred) JOIN (SELECT held AS fold, {BELOW_SQL} AS below FROM pred, (SELECT DISTINCT fold AS held FROM pred) WHERE fold <> held GROUP BY 1) USING (fold)
  UNION ALL SELECT 'uniform_random', fold, true_id, floor({UNIFORM_SQL} * {N})::INT FROM pred)"""


@query(scores_sql(PRED_SQL, DRAWN_SQL, source="drawn", keys="baseline, fold,", rule="zerofill"))
def prior_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of draws from the other folds' class shares and of draws from all labels alike."""
    rows = pred(spark, sf_dir)
    drawn = [("train_prior_random", P.prior_random(rows, N)), ("uniform_random", P.uniform_random(rows, N))]
    both = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("baseline"), "fold", "true_id", "pred_id") for name, d in drawn])
    return M.rounded(M.metrics(both, N, "zerofill", "baseline", "fold"))


@query(sql(PRED_SQL, body="SELECT max(n)::BIGINT AS majority_rows, sum(n)::BIGINT AS rows, round(max(n) / sum(n), 6) AS accuracy FROM (SELECT true_id, count(*) AS n FROM pred GROUP BY 1)"))
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pred(spark, sf_dir).groupBy("true_id").agg(F.count(F.lit(1)).alias("n"))
    return M.rounded(n.agg(F.max("n").alias("majority_rows"), F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("accuracy")))


@query(sql(PRED_SQL, body="SELECT event_id, round(pow(count(*) OVER (PARTITION BY true_id), -0.25), 6) AS weight FROM pred"))
def power_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(P.power_weights(pred(spark, sf_dir), "true_id", 0.25).select("event_id", "weight"))


@query(sql(PRED_SQL, f"s AS (SELECT group_id, count(*) AS n FROM pred WHERE true_id = {MAJORITY} GROUP BY 1)", body=f"SELECT event_id, round(CASE WHEN true_id = {MAJORITY} THEN (SELECT sum(n) / count(*) FROM s) / s.n ELSE 1 END, 6) AS weight FROM pred LEFT JOIN s USING (group_id)"))
def scene_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(P.scene_weights(pred(spark, sf_dir), "true_id", MAJORITY, "group_id").select("event_id", "weight"))


LINE_SQL = (
    "line AS (SELECT filename, true_id, units, sum(units) OVER (ORDER BY filename) - units AS low FROM (SELECT *, greatest(1, round(weight / max(weight) OVER () * 16777216))::BIGINT AS units FROM (SELECT filename, true_id, pow((count(*) OVER (PARTITION BY true_id))::DOUBLE, -1.0) AS weight FROM pred)))",
    "points AS (SELECT draw, (('0x' || substr(h, 1, 15))::BIGINT::HUGEINT * 1152921504606846976 + ('0x' || substr(h, 16, 15))::BIGINT) % (SELECT sum(units) FROM line)::HUGEINT AS point FROM (SELECT i AS draw, md5('42:' || i) AS h FROM (SELECT unnest(range((SELECT count(*) FROM pred))) AS i)))",
    "drawn AS (SELECT draw, filename, true_id FROM points ASOF JOIN line ON points.point >= line.low)",
)


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.power_weights(pred(spark, sf_dir), "true_id", 1.0).select("filename", "true_id", "weight")
    return weighted_sample_of(rows, "filename", "weight")


@query(sql(PRED_SQL, *LINE_SQL, body="SELECT true_id, count(*) AS draws, count(DISTINCT filename) AS files FROM drawn GROUP BY 1"))
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as rows, with replacement, by weight: draws and files of each class."""
    n = _drawn(spark, sf_dir).groupBy("true_id", "filename").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("true_id").agg(F.sum("n").alias("draws"), F.count(F.lit(1)).alias("files"))


@query(sql(PRED_SQL, *LINE_SQL, body="SELECT draw, filename FROM drawn"))
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of these draws hit."""
    return _drawn(spark, sf_dir).select("draw", "filename")


OTHER = f"(list_position(list_transform(probs, lambda x, i: CASE WHEN i = {MAJORITY + 1} THEN -1.0 ELSE x END), list_max(list_transform(probs, lambda x, i: CASE WHEN i = {MAJORITY + 1} THEN -1.0 ELSE x END))) - 1)::INT"


@query(sql(PRED_SQL, body=f"SELECT event_id, CASE WHEN probs[{MAJORITY + 1}] >= 0.3 THEN {MAJORITY} ELSE {OTHER} END AS pred_id FROM pred"))
def majority_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("event_id", P.majority_threshold("probs", MAJORITY, 0.3).cast("int").alias("pred_id"))


GRID = P.threshold_grid(0.05, 0.35, 0.01)


@query(
    sql(
        PRED_SQL, CLASS_SQL, f"grid AS (SELECT unnest({GRID}) AS t)", f"x AS (SELECT fold, true_id, {OTHER} AS other, probs[{MAJORITY + 1}] AS p FROM pred)",
        "folds AS (SELECT DISTINCT fold AS held FROM pred)",
        f"counts AS (SELECT held, t, true_id, CASE WHEN p >= t THEN {MAJORITY} ELSE other END AS pred_id, count(*) AS n FROM x, grid, folds WHERE fold <> held GROUP BY ALL)", class_sql("held, t,"),
        "s AS (SELECT held, t, round(sum(f1 * support) / sum(support), 9) AS f FROM clsf GROUP BY ALL)",
        body="SELECT held AS fold, round(t, 6) AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY held ORDER BY f DESC, t) = 1",
    )
)
def crossfit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(P.crossfit_thresholds(pred(spark, sf_dir), N, MAJORITY, GRID))


SPLIT_SQL = "split AS (SELECT *, pos <= greatest(2, least(CASE WHEN n * 6 % 10 = 5 THEN ((n * 6 // 10 + 1) // 2) * 2 ELSE (n * 6 + 5) // 10 END, n - 2)) AS is_support FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY frame, filename) AS pos FROM pred) WHERE n >= 4)"


@query(sql(PRED_SQL, SPLIT_SQL, body="SELECT event_id, group_id, is_support FROM split"))
def support_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.support_split(pred(spark, sf_dir)).select("event_id", "group_id", "is_support")


@query(sql(PRED_SQL, SPLIT_SQL, body="SELECT group_id, true_id, count(*) AS n, count(DISTINCT true_id) OVER (PARTITION BY group_id) AS classes FROM split WHERE is_support GROUP BY group_id, true_id"))
def support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.support_split(pred(spark, sf_dir)).filter("is_support").groupBy("group_id", "true_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("classes", F.count("true_id").over(Window.partitionBy("group_id")))


SHARES = "[" + ", ".join(f"(count(*) FILTER (WHERE true_id = {i}) + 1.0)" for i in range(N)) + "]"
PRIOR_ROWS = f"""own AS (SELECT group_id, {SHARES} AS c FROM split WHERE is_support GROUP BY 1), al AS (SELECT {SHARES} AS g FROM pred),
scored AS (SELECT fold, true_id, strength, list_transform(range(1, {N + 1}), lambda i: round(ln(greatest(probs[i], 1e-8)) + strength * (ln(c[i] / list_sum(c)) - ln(g[i] / list_sum(g))), 9)) AS z
  FROM split JOIN own USING (group_id), al, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS strength) WHERE NOT is_support),
res AS (SELECT fold, true_id, strength, (list_position(z, list_max(z)) - 1)::INT AS pred_id FROM scored)"""


@query(scores_sql(PRED_SQL, SPLIT_SQL, PRIOR_ROWS, source="res", keys="strength,", rule="present"))
def seen_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(P.seen_prior(pred(spark, sf_dir), N, [0.0, 0.05, 0.1, 0.2, 0.3]), N, "present", "strength"))


MEDIAN_SQL = f"""med AS (SELECT group_id, list(m ORDER BY i) AS median FROM (SELECT group_id, i, median(p) AS m FROM (SELECT group_id, unnest(range(1, {N + 1})) AS i, unnest(probs) AS p FROM split WHERE is_support) GROUP BY ALL) GROUP BY 1)"""


@query(sql(PRED_SQL, SPLIT_SQL, MEDIAN_SQL, body=f"SELECT group_id, {', '.join(f'round(median[{i + 1}], 6) AS m{i}' for i in range(N))} FROM med"))
def group_median_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.group_median(P.support_split(pred(spark, sf_dir)).filter("is_support"), "group_id")
    return M.rounded(m.select("group_id", *[F.get("median", F.lit(i)).alias(f"m{i}") for i in range(N)]))


SMOOTH_ROWS = f"""z AS (SELECT fold, true_id, share, list_transform(range(1, {N + 1}), lambda i: round((1 - share) * probs[i] + share * median[i], 9)) AS z FROM split JOIN med USING (group_id), (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS share) WHERE NOT is_support),
res AS (SELECT fold, true_id, share, (list_position(z, list_max(z)) - 1)::INT AS pred_id FROM z)"""


@query(scores_sql(PRED_SQL, SPLIT_SQL, MEDIAN_SQL, SMOOTH_ROWS, source="res", keys="share,", rule="present"))
def temporal_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(P.smoothed(pred(spark, sf_dir), [0.0, 0.1, 0.2, 0.3, 0.5]), N, "present", "share"))


@query(
    sql(
        PRED_SQL, "tr AS (SELECT group_id, count(*) AS n_train FROM pred WHERE fold = 0 AND true_id = 1 GROUP BY 1)", "te AS (SELECT group_id, count(*) AS n_test FROM pred WHERE fold <> 0 GROUP BY 1)",
        body="SELECT event_id, CASE WHEN n_train > 0 THEN 'train' WHEN n_test >= 3 THEN 'test' ELSE 'skip' END AS context FROM pred LEFT JOIN tr USING (group_id) LEFT JOIN te USING (group_id)",
    )
)
def context_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a row: its group's training rows, else its test rows if there are three, else none."""
    rows = pred(spark, sf_dir)
    n = rows.groupBy("group_id").agg(F.count_if((F.col("fold") == 0) & (F.col("true_id") == 1)).alias("n_train"), F.count_if(F.col("fold") != 0).alias("n_test"))
    context = F.when(F.col("n_train") > 0, "train").when(F.col("n_test") >= 3, "test").otherwise("skip")
    return rows.join(n, "group_id").select("event_id", context.alias("context"))


FOUR_SQL = "four AS (SELECT event_id, k, 1.0 + ((w[1] + k * 3) % 7) AS a, 1.0 + ((w[2] + k * 5) % 7) AS b FROM pred, (SELECT unnest(range(4)) AS k))"


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models' scores of each file."""
    rows = pred(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = lambda i, m: 1.0 + (F.get("w", F.lit(i)) + F.col("k") * m) % 7
    return rows.select("event_id", "k", at(0, 3).alias("a"), at(1, 5).alias("b"))


@query(sql(PRED_SQL, FOUR_SQL, body="SELECT event_id, round(avg(a / (a + b)), 6) AS p0, round(avg(b / (a + b)), 6) AS p1 FROM four GROUP BY 1"))
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(_four(spark, sf_dir).groupBy("event_id").agg(F.avg(F.expr("a / (a + b)")).alias("p0"), F.avg(F.expr("b / (a + b)")).alias("p1")))


@query(sql(PRED_SQL, FOUR_SQL, body="SELECT event_id, round(sum(a / (a + b) * [0.1, 0.2, 0.3, 0.4][k + 1]), 6) AS p0, round(sum(b / (a + b) * [0.1, 0.2, 0.3, 0.4][k + 1]), 6) AS p1 FROM four GROUP BY 1"))
def ensemble_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.get(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]), F.col("k"))
    return M.rounded(_four(spark, sf_dir).groupBy("event_id").agg(F.sum(F.expr("a / (a + b)") * weight).alias("p0"), F.sum(F.expr("b / (a + b)") * weight).alias("p1")))


WEIGHTS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5]
BLEND_SQL = f"""z AS (SELECT a.filename, a.true_id, a.fold, a.pred_id AS first_id, weight, list_transform(range(1, {N + 1}), lambda i: round((1 - weight) * a.probs[i] + weight * b.probs[i], 9)) AS z FROM pred a JOIN pred2 b USING (filename), (SELECT unnest({WEIGHTS})::DOUBLE AS weight)),
blend AS (SELECT filename, true_id, fold, weight, (list_position(z, list_max(z)) - 1)::INT AS pred_id, (list_position(z, list_max(z)) - 1) <> first_id AS changed FROM z)"""


def _blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blended(pred(spark, sf_dir), pred2(spark, sf_dir), WEIGHTS)


@query(scores_sql(PRED_SQL, PRED2_SQL, BLEND_SQL, source="blend", keys="weight,", rule="present"))
def weak_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.metrics(_blend(spark, sf_dir), N, "present", "weight"))


@query(sql(PRED_SQL, PRED2_SQL, BLEND_SQL, body="SELECT weight, coalesce(CASE fold WHEN 0 THEN 'unseen' WHEN 1 THEN 'direct' END, 'unmapped') AS status, count(*) AS changed FROM blend WHERE changed GROUP BY ALL"))
def blend_changed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed predictions by the files' status, `unmapped` for files without one."""
    rows = _blend(spark, sf_dir).filter("changed")
    status = pred(spark, sf_dir).filter("fold < 2").select("filename", F.when(F.col("fold") == 0, "unseen").otherwise("direct").alias("status"))
    return rows.join(status, "filename", "left").groupBy("weight", F.coalesce("status", F.lit("unmapped")).alias("status")).agg(F.count(F.lit(1)).alias("changed"))


@query(sql(PRED_SQL, PRED2_SQL, body="SELECT filename FROM pred INTERSECT SELECT filename FROM pred2"))
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("filename").intersect(pred2(spark, sf_dir).select("filename"))


FACTORS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]
ALPHA_SQL = f"""z AS (SELECT event_id, filename, true_id, factor, pred_id AS base_id, list_transform(range(1, {N + 1}), lambda i: round(CASE WHEN i = {MAJORITY + 1} THEN probs[i] * factor ELSE probs[i] END, 9)) AS z, probs FROM pred, (SELECT unnest({FACTORS})::DOUBLE AS factor)),
alpha AS (SELECT *, (list_position(z, list_max(z)) - 1)::INT AS pred_id FROM z)"""


@query(sql(PRED_SQL, CLASS_SQL, ALPHA_SQL, "counts AS (SELECT factor, true_id, pred_id, count(*) AS n FROM alpha GROUP BY ALL)", class_sql("factor,"), f"m AS ({metric_sql('nanmean', 'factor,')})", body="SELECT factor, weighted_f1, round(weighted_f1 - (SELECT weighted_f1 FROM m WHERE factor = 1), 6) AS delta FROM m"))
def alpha_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.rounded(M.metrics(P.class_scaled(pred(spark, sf_dir), MAJORITY, FACTORS), N, "nanmean", "factor"))
    base = m.filter("factor = 1").select(F.col("weighted_f1").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("factor", "weighted_f1", F.round(F.col("weighted_f1") - F.col("base"), 6).alias("delta"))


@query(sql(PRED_SQL, ALPHA_SQL, body=f"SELECT factor, filename, round(probs[{MAJORITY + 1}], 6) AS p FROM alpha WHERE pred_id = {MAJORITY} QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(probs[{MAJORITY + 1}], 9) DESC, filename) <= 5"))
def alpha_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files of each scenario: a top-k report."""
    rows = P.class_scaled(pred(spark, sf_dir), MAJORITY, FACTORS).filter(F.col("pred_id") == MAJORITY)
    p = F.get("probs", F.lit(MAJORITY))
    at = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc(F.round(p, 9)), "filename"))
    return rows.withColumn("at", at).filter("at <= 5").select("factor", "filename", F.round(p, 6).alias("p"))


@query(sql(PRED_SQL, body=f"SELECT event_id, CASE WHEN pred_id = {MAJORITY} AND round(probs[{MAJORITY + 1}] * 1.2 - greatest(probs[1], probs[2]), 9) < 0.1 THEN (CASE WHEN probs[1] >= probs[2] THEN 0 ELSE 1 END) ELSE pred_id END AS pred_id FROM pred"))
def margin_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("event_id", P.margin_rule(F.col("probs"), F.col("pred_id"), MAJORITY, 0, 1, 1.2, 0.1).cast("int").alias("pred_id"))


LOGIT = "list_transform(w, lambda x: x / 8.0)"
SOFT = "list_transform(z, lambda x: exp(x - list_max(z)))"


@query(sql(PRED_SQL, f"l AS (SELECT event_id, {LOGIT} AS z FROM pred)", f"s AS (SELECT event_id, {SOFT} AS e FROM l)", body="SELECT event_id, " + ", ".join(f"round(e[{i + 1}] / list_sum(e), 6) AS p{i}" for i in range(N)) + " FROM s"))
def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).select("event_id", F.transform("w", lambda x: x / 8.0).alias("z"))
    rows = rows.select("event_id", vectors.softmax("z").alias("p"))
    return M.rounded(rows.select("event_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(N)]))


@query(sql(PRED_SQL, f"g AS (SELECT {SHARES} AS c FROM pred)", f"a AS (SELECT event_id, list_transform(range(1, {N + 1}), lambda i: round(w[i] / 8.0 + 0.5 * ln(c[i] / list_sum(c)), 9)) AS z FROM pred, g)", body="SELECT event_id, (list_position(z, list_max(z)) - 1)::INT AS pred_id, round(list_max(z), 6) AS top FROM a"))
def logit_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir)
    prior = P.class_shares(rows, N)
    z = F.zip_with("w", "shares", lambda w, s: F.round(w / 8.0 + 0.5 * F.log(s), 9))
    return rows.crossJoin(F.broadcast(prior)).select("event_id", z.alias("z")).select("event_id", vectors.argmax("z").alias("pred_id"), F.round(F.array_max("z"), 6).alias("top"))


@query(sql(PRED_SQL, f"g AS (SELECT {SHARES} AS c FROM pred)", f"a AS (SELECT event_id, true_id, list_transform(range(1, {N + 1}), lambda i: w[i] / 8.0 + ln(c[i] / list_sum(c))) AS z FROM pred, g)", body="SELECT event_id, round(ln(list_sum(list_transform(z, lambda x: exp(x)))) - 0.9 * z[true_id + 1] - 0.1 * list_sum(z) / len(z), 5) AS loss FROM a"))
def balanced_softmax_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir)
    loss = P.balanced_softmax_loss(F.transform("w", lambda x: x / 8.0), F.col("shares"), F.col("true_id"), 0.1)
    return rows.crossJoin(F.broadcast(P.class_shares(rows, N))).select("event_id", F.round(loss, 5).alias("loss"))


GATE_SQL = ("counts AS (SELECT model, true_id, pred_id, count(*) AS n FROM (SELECT 'a' AS model, true_id, pred_id FROM pred JOIN (SELECT filename FROM pred2) USING (filename) UNION ALL SELECT 'b', true_id, pred_id FROM pred2) GROUP BY ALL)", class_sql("model,"), f"m AS ({metric_sql('nanmean', 'model,')})")


@query(sql(PRED_SQL, PRED2_SQL, CLASS_SQL, *GATE_SQL, body="SELECT a.weighted_f1 AS old_f1, b.weighted_f1 AS new_f1, b.weighted_f1 >= a.weighted_f1 AS f1_kept, b.miou >= a.miou - 0.005 AS miou_kept, b.weighted_f1 >= a.weighted_f1 AND b.miou >= a.miou - 0.005 AS promoted FROM m a, m b WHERE a.model = 'a' AND b.model = 'b'"))
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second model may replace the first, on common files."""
    new = pred2(spark, sf_dir)
    old = pred(spark, sf_dir).join(new.select("filename"), "filename", "left_semi")
    a, b = (M.rounded(M.metrics(x, N, "nanmean")) for x in (old, new))
    both = a.select(F.col("weighted_f1").alias("old_f1"), F.col("miou").alias("old_miou")).crossJoin(b.select(F.col("weighted_f1").alias("new_f1"), F.col("miou").alias("new_miou")))
    f1, miou = F.col("new_f1") >= F.col("old_f1"), F.col("new_miou") >= F.col("old_miou") - 0.005
    return both.select("old_f1", "new_f1", f1.alias("f1_kept"), miou.alias("miou_kept"), (f1 & miou).alias("promoted"))


@query(sql(PRED_SQL, PRED2_SQL, body="SELECT CASE WHEN a.true_id = a.pred_id THEN (CASE WHEN b.true_id = b.pred_id THEN 'both_correct' ELSE 'new_error' END) ELSE (CASE WHEN b.true_id = b.pred_id THEN 'resolved' ELSE 'persistent' END) END AS transition, count(*) AS n FROM pred a JOIN pred2 b USING (filename) GROUP BY 1"))
def error_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pred(spark, sf_dir).select("filename", (F.col("true_id") == F.col("pred_id")).alias("was"))
    b = pred2(spark, sf_dir).select("filename", (F.col("true_id") == F.col("pred_id")).alias("now"))
    say = F.when(F.col("was") & F.col("now"), "both_correct").when(F.col("was"), "new_error").when(F.col("now"), "resolved").otherwise("persistent")
    return a.join(b, "filename").groupBy(say.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(PRED_SQL, body="SELECT group_id AS held_out, count(*) AS n_val, (SELECT count(*) FROM pred) - count(*) AS n_train FROM pred GROUP BY 1"))
def scene_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the split that leaves each scene out."""
    n = pred(spark, sf_dir).groupBy(F.col("group_id").alias("held_out")).agg(F.count(F.lit(1)).alias("n_val"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n_val").alias("size")))).select("held_out", "n_val", (F.col("size") - F.col("n_val")).alias("n_train"))


@query(sql(PRED_SQL, body="SELECT group_id, count(*) FILTER (WHERE true_id = 1) AS positives, count(*) FILTER (WHERE true_id = 1 AND pred_id = 1) AS tp, round(count(*) FILTER (WHERE true_id = 1 AND pred_id = 1) / nullif(count(*) FILTER (WHERE true_id = 1), 0), 6) AS recall, round(count(*) FILTER (WHERE true_id = 1 AND pred_id = 1) / nullif(count(*) FILTER (WHERE pred_id = 1), 0), 6) AS precision, round(count(*) FILTER (WHERE true_id <> 1 AND pred_id = 1) / nullif(count(*) FILTER (WHERE true_id <> 1), 0), 6) AS fp_rate FROM pred GROUP BY 1"))
def scene_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("true_id") == 1, F.col("pred_id") == 1
    rows = pred(spark, sf_dir).groupBy("group_id").agg(F.count_if(t).alias("positives"), F.count_if(t & p).alias("tp"), F.count_if(p).alias("said"), F.count_if(~t).alias("negatives"))
    return M.rounded(rows.select("group_id", "positives", "tp", F.try_divide("tp", "positives").alias("recall"), F.try_divide("tp", "said").alias("precision"), F.try_divide(F.col("said") - F.col("tp"), "negatives").alias("fp_rate")))


@query("SELECT l_suppkey AS run, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean batch loss weighted by batch size."""
    return M.rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("loss")))


@query(sql(PRED_SQL, "v AS (SELECT event_id, list_transform(probs, lambda x, i: CASE WHEN i = 1 AND event_id % 97 = 0 THEN x + 0.1 ELSE x END) AS p FROM pred)", body="SELECT event_id FROM v WHERE abs(list_sum(p) - 1) > 2e-5 OR list_min(p) < 0 OR list_max(p) > 1"))
def prob_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose probabilities aren't finite, in [0, 1] and summing to 1; some are damaged here."""
    from ..operators.validate import simplex_violations

    rows = pred(spark, sf_dir).withColumn("probs", F.transform("probs", lambda x, i: F.when((i == 0) & (F.col("event_id") % 97 == 0), x + 0.1).otherwise(x)))
    return simplex_violations(rows, "probs", N).select("event_id")


@query(sql(PRED_SQL, body="SELECT filename, " + ", ".join(f"printf('%.6f', w[{i + 1}] / 7.0) AS p_{x}" for i, x in enumerate(LABELS)) + " FROM pred"))
def prob_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("filename", *[F.format_string("%.6f", F.get("w", F.lit(i)) / 7.0).alias(f"p_{x}") for i, x in enumerate(LABELS)])


@query(sql(PRED_SQL, CLASS_SQL, ALPHA_SQL, "counts AS (SELECT factor, true_id, pred_id, count(*) AS n FROM alpha GROUP BY ALL)", class_sql("factor,"), f"m AS ({metric_sql('nanmean', 'factor,')})", body="SELECT factor, weighted_f1 FROM m ORDER BY weighted_f1 DESC, factor LIMIT 1"))
def best_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.rounded(M.metrics(P.class_scaled(pred(spark, sf_dir), MAJORITY, FACTORS), N, "nanmean", "factor"))
    return P.best_parameter(m, "factor", "weighted_f1").select("factor", "weighted_f1")


@query("""WITH h AS (SELECT l_suppkey AS run, date_trunc('month', l_shipdate) AS m, round(avg(l_discount), 6) AS metric FROM lineitem GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY m) AS epoch FROM h),
i AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM e),
s AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM i),
z AS (SELECT *, min(CASE WHEN stale >= 3 THEN epoch END) OVER (PARTITION BY run) AS ended FROM s)
SELECT run, epoch, metric, improved, stale, coalesce(epoch > ended, false) AS stopped FROM z""")
def early_stop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.date_trunc("month", "l_shipdate").alias("m")).agg(F.round(F.avg("l_discount"), 6).alias("metric"))
    history = history.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("m")).cast("long"))
    return P.early_stop(history, "run", "epoch", "metric", 3).select("run", "epoch", "metric", "improved", "stale", "stopped")


@query(sql(PRED_SQL, CLASS_SQL, "folds AS (SELECT DISTINCT fold FROM pred)", body="SELECT f.fold, class_id, round(coalesce(avg(p.probs[class_id + 1]), 0), 6) AS p FROM folds f CROSS JOIN class LEFT JOIN pred p ON p.fold = f.fold AND p.true_id = class_id GROUP BY ALL"))
def scatter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean own-class probability of each fold with every class in place, absent ones 0."""
    rows = pred(spark, sf_dir)
    known = rows.groupBy("fold", F.col("true_id").alias("class_id")).agg(F.avg(F.get("probs", F.col("true_id"))).alias("p"))
    every = known.select("fold").distinct().withColumn("class_id", F.explode(F.array(*[F.lit(i) for i in range(N)])))
    return M.rounded(every.join(known, ["fold", "class_id"], "left").select("fold", "class_id", F.coalesce("p", F.lit(0.0)).alias("p")))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).cast("int").alias("fold"), F.col("label").alias("true_id"), F.col("embedding").alias("features"))


@query()
def frozen_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of a softmax regression on fixed features; no SQL."""
    return out_of_fold(_features(spark, sf_dir), 10).select("id", "fold", "true_id", "pred_id")


@query(
    "WITH x AS (SELECT (vec_id % 4)::INT AS fold, [1.0::DOUBLE] || list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), p AS (SELECT fold, v, unnest(range(65)) AS i FROM x), q AS (SELECT fold, i, v, unnest(range(65)) AS j FROM p) SELECT fold, i::INT AS i, j::INT AS j, round(sum(v[i + 1] * v[j + 1]), 4) AS total FROM q GROUP BY ALL"
)
def fold_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the regressions of all folds begin with: counts, sums and products of the features."""
    found = moments(_features(spark, sf_dir))
    rows = [(f, i, j, float(v)) for f, m in found.items() for i, line in enumerate(m) for j, v in enumerate(line)]
    # features x features for each fold, whatever the rows
    return spark.createDataFrame(rows, "fold int, i int, j int, total double").withColumn("total", F.round("total", 4))
