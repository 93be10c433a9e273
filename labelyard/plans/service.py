"""Queries on rasters, the alert service and event windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as T
from ..operators import service as S
from ..operators.postproc import exact_median
from .fixtures import MANIFEST_SQL, manifest, sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


PIXEL_SQL = "px AS (SELECT vec_id * 64 + i AS id, vec_id // 50 AS tile, vec_id AS row, i AS col, e[i + 1]::DOUBLE AS green, e[(i + 1) % 64 + 1]::DOUBLE AS nir FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("col"))
    at = lambda i: F.get("embedding", i).cast("double")
    return rows.select((F.col("vec_id") * 64 + F.col("col")).alias("id"), F.floor(F.col("vec_id") / 50).alias("tile"), F.col("vec_id").alias("row"), "col", at(F.col("col")).alias("green"), at((F.col("col") + 1) % 64).alias("nir"))


@query(sql(PIXEL_SQL, body="SELECT id, round(CASE WHEN green + nir <> 0 THEN (green - nir) / (green + nir) END, 6) AS ndwi FROM px"))
def ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", F.round(T.normalized_difference(F.col("green"), F.col("nir")), 6).alias("ndwi"))


@query(
    sql(
        PIXEL_SQL, "h AS (SELECT tile, greatest(0, least(31, floor((green + 1) / 2 * 32)))::INT AS bin, count(*) AS n FROM px GROUP BY ALL)",
        "w AS (SELECT tile, bin, sum(n) OVER u AS n0, sum(n * bin) OVER u AS s0, sum(n) OVER (PARTITION BY tile) AS n, sum(n * bin) OVER (PARTITION BY tile) AS s FROM h WINDOW u AS (PARTITION BY tile ORDER BY bin))",
        "v AS (SELECT tile, bin, round(coalesce(CASE WHEN n > n0 THEN n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) END, 0), 6) AS b FROM w)",
        body="SELECT tile, bin AS threshold_bin FROM v QUALIFY row_number() OVER (PARTITION BY tile ORDER BY b DESC, bin) = 1",
    )
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.otsu(pixels(spark, sf_dir), "tile", "green")


@query(
    sql(
        PIXEL_SQL, "wet AS (SELECT id, tile, row, col FROM px WHERE green > 0.15)",
        "edge AS (SELECT a.id AS a, b.id AS b FROM wet a JOIN wet b ON a.tile = b.tile AND abs(a.row - b.row) + abs(a.col - b.col) = 1)",
        "reach AS (SELECT id AS a, id AS b FROM wet UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)", "comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)",
        "big AS (SELECT id FROM comp JOIN (SELECT c FROM comp GROUP BY 1 HAVING count(*) >= 3) USING (c))", body="SELECT id, CASE WHEN id IN (SELECT id FROM big) THEN 1 ELSE 0 END AS water FROM px",
    )
)
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.water_mask(pixels(spark, sf_dir), F.col("green"), 0.15, 3)


PAIR_SQL = "two AS (SELECT id, tile, row, col, CASE WHEN col * (tile % 4 + 1) >= 64 THEN green END AS before, nir AS after FROM px)"


def _two_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands as two times; of a quarter of the tiles the first has no value, of others some."""
    rows = pixels(spark, sf_dir)
    seen = F.col("col") * (F.col("tile") % 4 + 1) >= 64
    return rows.select("id", "tile", "row", "col", F.when(seen, F.col("green")).alias("before"), F.col("nir").alias("after"))


@query(sql(PIXEL_SQL, PAIR_SQL, body="SELECT tile, pixels, valid, round(valid / pixels, 6) AS coverage, CASE WHEN valid / pixels < 0.5 THEN 'rejected' WHEN valid / pixels < 0.7 THEN 'low_quality' ELSE 'normal' END AS level FROM (SELECT tile, count(*) AS pixels, count(before) AS valid FROM two GROUP BY 1)"))
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.coverage(_two_times(spark, sf_dir), "tile", F.col("before").isNotNull() & F.col("after").isNotNull())
    return rows.withColumn("coverage", F.round("coverage", 6))


@query(
    sql(
        PIXEL_SQL, PAIR_SQL, "good AS (SELECT tile, CASE WHEN count(before) / count(*) < 0.7 THEN 'low_quality' ELSE 'normal' END AS level FROM two GROUP BY 1 HAVING count(before) / count(*) >= 0.5)",
        "ch AS (SELECT id, tile, row, col, level, CASE WHEN before <= 0 AND after > 0 THEN 'gain' WHEN before > 0 AND after <= 0 THEN 'loss' END AS change FROM two JOIN good USING (tile) WHERE before IS NOT NULL AND after IS NOT NULL)",
        "wet AS (SELECT * FROM ch WHERE change IS NOT NULL)", "edge AS (SELECT a.id AS a, b.id AS b FROM wet a JOIN wet b ON a.tile = b.tile AND a.change = b.change AND abs(a.row - b.row) + abs(a.col - b.col) = 1)",
        "reach AS (SELECT id AS a, id AS b FROM wet UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)", "comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)",
        "inner_sides AS (SELECT a AS id, count(*) AS n FROM edge GROUP BY 1)",
        body="SELECT component, tile, change, count(*) AS pixels, (4 * count(*) - sum(coalesce(n, 0)))::BIGINT AS edges, count(*) * 100.0::DOUBLE AS area, (4 * count(*) - sum(coalesce(n, 0))) * 10.0::DOUBLE AS length, level FROM wet JOIN comp USING (id) LEFT JOIN inner_sides USING (id) GROUP BY ALL HAVING count(*) * 100 >= 500",
    )
)
def change_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and outline lengths of gains and losses between two times, on a grid of 10 metres."""
    found, _ = T.change_polygons(_two_times(spark, sf_dir), F.col("before"), F.col("after"), 0.0, 10.0)
    return found.select("component", "tile", "change", "pixels", "edges", "area", "length", "level")


@query(sql(PIXEL_SQL, body="SELECT tile, col, round(median(green), 6) AS green FROM px GROUP BY ALL"))
def median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by rank, as a window of a hot tile may hold more values than a task's memory."""
    return exact_median(pixels(spark, sf_dir), ["tile", "col"], "green").select("tile", "col", F.round("median", 6).alias("green"))


@query("SELECT l_suppkey AS tile, concat_ws(',', CASE WHEN a.h IS DISTINCT FROM b.h THEN 'height' END) AS differs FROM (SELECT l_suppkey, count(*) AS h FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a FULL JOIN (SELECT l_suppkey, count(*) AS h FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (l_suppkey)")
def raster_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tilings compared by grid fields."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), "l_linestatus").agg(F.count(F.lit(1)).alias("height"))
    return T.misaligned(n.filter("l_linestatus = 'F'"), n.filter("l_linestatus = 'O'"), ("height",))


@query(sql(MANIFEST_SQL, "g AS (SELECT filename, 448.0 / greatest(width, height) AS s, width, height FROM manifest)", "b AS (SELECT filename, greatest(1, round_even(width * s, 0))::INT AS w, greatest(1, round_even(height * s, 0))::INT AS h FROM g)", body="SELECT filename, w AS new_width, h AS new_height, floor((448 - w) / 2)::INT AS pad_left, floor((448 - h) / 2)::INT AS pad_top FROM b"))
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, left, top = T.resize_geometry(F.col("width"), F.col("height"), 448)
    return manifest(spark, sf_dir).select("filename", w.alias("new_width"), h.alias("new_height"), left.alias("pad_left"), top.alias("pad_top"))


ALERT_SQL = "alerts AS (SELECT 'ALT-' || event_id AS alert_id, 'pending' AS status, event_type || ' ' || printf('%.2f', value) AS rule_summary, ts AS created_at FROM events WHERE event_type = 'error')"
ACTION_SQL = """acts AS (SELECT 'ALT-' || e.event_id AS alert_id, CASE (a.event_id + e.event_id) % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'later' END AS action, a.ts, CASE WHEN a.event_id % 2 = 0 THEN 'noise' ELSE ' ' END AS reason
  FROM events e JOIN events a ON a.user_id = e.user_id AND a.event_type = 'view' AND a.event_id > e.event_id AND a.event_id <= e.event_id + 300 WHERE e.event_type = 'error'),
firsts AS (SELECT * FROM acts WHERE action = 'confirm' OR (action = 'reject' AND trim(reason) <> '') QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts, action, reason) = 1),
reviewed AS (SELECT alert_id, CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE status END AS status, ts AS reviewed_at, CASE WHEN action = 'reject' THEN reason END AS reject_reason FROM alerts LEFT JOIN firsts USING (alert_id)),
evs AS (SELECT 'EVT-' || substr(alert_id, 5) AS event_id, alert_id, 'open' AS status, reviewed_at AS created_at FROM reviewed WHERE status = 'confirmed')"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as detections, each delivered twice."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("detection_id"), F.col("event_type").alias("category"), F.col("value").alias("confidence"), "ts")
    return rows.unionByName(rows)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review actions: later views of the same user; ids are cut into buckets for the range."""
    e = table(spark, sf_dir, "events")
    wide = F.floor(F.col("event_id") / 300)
    a = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), "ts", wide.alias("bucket"))
    d = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("d"), F.explode(F.array(wide, wide + 1)).alias("bucket"))
    rows = d.join(a, ["user_id", "bucket"]).filter("a > d and a <= d + 300")
    say = F.when((F.col("a") + F.col("d")) % 3 == 0, "confirm").when((F.col("a") + F.col("d")) % 3 == 1, "reject").otherwise("later")
    return rows.select(F.concat(F.lit("ALT-"), F.col("d").cast("string")).alias("alert_id"), say.alias("action"), "ts", F.when(F.col("a") % 2 == 0, "noise").otherwise(" ").alias("reason"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reviewed(S.alerts(detections(spark, sf_dir)), actions(spark, sf_dir))


@query(sql(ALERT_SQL, body="SELECT * FROM alerts"))
def alerts_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alerts(detections(spark, sf_dir))


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT alert_id, status, reviewed_at, reject_reason FROM reviewed"))
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir)


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT alert_id, reviewed_at FROM reviewed WHERE status = 'rejected'"))
def alerts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_status(_reviewed(spark, sf_dir), "rejected").select("alert_id", "reviewed_at")


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT status, count(*) AS n FROM reviewed GROUP BY 1"))
def alert_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT * FROM evs"))
def governance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(_reviewed(spark, sf_dir))


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT 'WO-' || r.event_id AS order_id, evs.event_id, 'user' || user_id AS assignee, 'pending' AS status FROM events r JOIN evs ON evs.event_id = 'EVT-' || r.event_id WHERE r.user_id % 2 = 0"))
def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id % 2 = 0")
    requests = e.select(F.concat(F.lit("EVT-"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_id").alias("request_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("assignee"))
    return S.work_orders(S.events(_reviewed(spark, sf_dir)), requests)


UPDATE_SQL = "up AS (SELECT 'WO-' || user_id AS order_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' ELSE 'broken' END AS status, ts, CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id ELSE '' END AS feedback FROM events)"


@query(sql(UPDATE_SQL, "ok AS (SELECT * FROM up WHERE status <> 'broken')", "g AS (SELECT order_id, max_by(status, struct_pack(ts := ts, status := status)) AS status, max_by(feedback, ts) FILTER (WHERE feedback <> '') AS feedback, max(ts) FILTER (WHERE status = 'completed') AS done FROM ok GROUP BY 1)", body="SELECT order_id, status, feedback, CASE WHEN status = 'completed' THEN done END AS completed_at FROM g"))
def work_order_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "in_progress").when(kind == "purchase", "completed").otherwise("broken")
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).otherwise("")
    return S.latest_orders(table(spark, sf_dir, "events").select(F.concat(F.lit("WO-"), F.col("user_id").cast("string")).alias("order_id"), status.alias("status"), "ts", note.alias("feedback")))


@query(sql(ALERT_SQL, ACTION_SQL, body="SELECT 'alert' AS kind, alert_id AS id, created_at AS at FROM alerts UNION ALL SELECT 'event', event_id, created_at FROM evs"))
def replay_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replay(alert=(S.alerts(detections(spark, sf_dir)), "alert_id", "created_at"), event=(S.events(_reviewed(spark, sf_dir)), "event_id", "created_at"))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_counts(table(spark, sf_dir, "events"), F.window("ts", "15 minutes"), "event_type")


@query("SELECT s - INTERVAL '5 minutes' * k AS start, s - INTERVAL '5 minutes' * k + INTERVAL '15 minutes' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS s FROM events), range(3) r(k) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_counts(table(spark, sf_dir, "events"), F.window("ts", "15 minutes", "5 minutes"), "event_type")


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_counts(table(spark, sf_dir, "events"), F.session_window("ts", "2 hours"), "user_id")
