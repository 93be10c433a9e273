"""Views of the given tables in the roles of the operators' inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, vectors

#: Event types in order, then a class that is only predicted and one that never occurs.
LABELS = ("click", "error", "purchase", "signup", "view", "idle", "void")
#: Plays the majority class.
MAJORITY = 4
SQL_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weights(step: int) -> Column:
    e = F.col("event_id")
    return vectors.once("k", lambda k: F.array(*[F.lit(1) + (k * (i + step) + e * (i + 1)) % 17 for i in range(6)], F.lit(0).cast("long")))


def pred(spark: SparkSession, sf_dir: str, step: int = 3) -> DataFrame:
    """Predictions: filename, group_id, fold, frame, true_id, w (whole numbers), probs, pred_id."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.select(
        "event_id", F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("user_id").alias("group_id"), (F.col("user_id") % 4).cast("int").alias("fold"),
        F.col("event_id").alias("frame"), names.encode("event_type", LABELS).alias("true_id"), _weights(step).alias("w"),
    )
    size = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)
    probs = vectors.once("w", lambda w: vectors.once(size(w), lambda size: F.transform(w, lambda x: x / size)))
    return rows.withColumn("probs", probs).withColumn("pred_id", vectors.argmax("w"))


def pred2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second model, without every third file."""
    return pred(spark, sf_dir, 5).filter("event_id % 3 <> 0")


def _pred_sql(step: int, name: str, where: str = "") -> str:
    w = ", ".join(f"1 + (k * {i + step} + event_id * {i + 1}) % 17" for i in range(6))
    return f"""{name} AS (SELECT *, (list_position(w, list_max(w)) - 1)::INT AS pred_id, list_transform(w, lambda x: x / list_sum(w)) AS probs FROM (
  SELECT event_id, event_id || '.jpg' AS filename, user_id AS group_id, (user_id % 4)::INT AS fold, event_id AS frame,
    (list_position({SQL_LABELS}, event_type) - 1)::INT AS true_id, [{w}, 0] AS w
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) {where}))"""


PRED_SQL = _pred_sql(3, "pred")
PRED2_SQL = _pred_sql(5, "pred2", "WHERE event_id % 3 <> 0")
CLASS_SQL = f"class AS (SELECT (i - 1)::INT AS class_id, {SQL_LABELS}[i] AS label FROM (SELECT unnest(range(1, {len(LABELS)} + 1)) AS i))"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: relative_path, filename, split, label, frame_id, sizes, sha256."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    number = F.col("doc_id").cast("string")
    part = F.substring("source", 4, 9).cast("int") % 5
    split = F.when(part == 0, "val").when(part == 1, "test").otherwise("train")
    name = F.concat(number, F.when(F.col("doc_id") % 10 == 0, ".png").otherwise(".jpg"))
    width, height = (F.col("n_chars") % 640 + 1).cast("int"), (F.col("n_chars") % 480 + 1).cast("int")
    known = F.col("quality").isNotNull()
    return docs.select(
        "doc_id", name.alias("filename"), F.concat_ws("/", split, "source", name).alias("relative_path"), split.alias("split"), "source", "lang",
        F.when(known, F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("label"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("frame_id"),
        width.alias("width"), height.alias("height"), F.when(known, width + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).alias("declared_width"), F.when(known, height).alias("declared_height"),
        F.sha2("text", 256).alias("sha256"),
    )


MANIFEST_SQL = """manifest AS (SELECT doc_id, filename, split || '/' || source || '/' || filename AS relative_path, split, source, lang,
    CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS label, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS frame_id, width, height,
    CASE WHEN quality IS NOT NULL THEN width + (CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END) END AS declared_width, CASE WHEN quality IS NOT NULL THEN height END AS declared_height, sha256
  FROM (SELECT d.*, l.quality, sha256(d.text) AS sha256, d.doc_id || (CASE WHEN d.doc_id % 10 = 0 THEN '.png' ELSE '.jpg' END) AS filename,
    CASE substr(source, 4)::INT % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, (n_chars % 640 + 1)::INT AS width, (n_chars % 480 + 1)::INT AS height
    FROM documents d LEFT JOIN labels l USING (doc_id)))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every seventh labelled file; half of them change the label."""
    m = manifest(spark, sf_dir).filter("label is not null and doc_id % 7 = 0")
    other = F.when(F.col("label") == "good", "bad").otherwise("good")
    new = F.when(F.col("width") % 2 == 1, other).otherwise(F.col("label"))
    return m.select("doc_id", "filename", F.when(F.col("doc_id") % 35 == 0, other).otherwise(F.col("label")).alias("official_label"), new.alias("reviewed_label"), F.when(F.col("width") % 5 == 0, "uncertain").when(F.col("width") % 2 == 1, "relabel").otherwise("confirmed").alias("review_status"), F.when(F.col("doc_id") % 21 == 0, " ").otherwise("seen").alias("review_notes"))


DECISIONS_SQL = """decisions AS (SELECT doc_id, filename, CASE WHEN doc_id % 35 = 0 THEN other ELSE label END AS official_label, CASE WHEN width % 2 = 1 THEN other ELSE label END AS reviewed_label,
    CASE WHEN width % 5 = 0 THEN 'uncertain' WHEN width % 2 = 1 THEN 'relabel' ELSE 'confirmed' END AS review_status, CASE WHEN doc_id % 21 = 0 THEN ' ' ELSE 'seen' END AS review_notes
  FROM (SELECT *, CASE label WHEN 'good' THEN 'bad' ELSE 'good' END AS other FROM manifest WHERE label IS NOT NULL AND doc_id % 7 = 0))"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit image hashes with a directory and a frame number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), F.floor(F.col("vec_id") / 250).cast("string")).alias("dir"), F.col("vec_id").alias("frame"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), vectors.bits("embedding", 64).alias("hash"), "label")


HASHES_SQL = """hashes AS (SELECT vec_id AS id, 'd' || (vec_id // 250) AS dir, vec_id AS frame, sha256(vec_id::VARCHAR) AS sha256, label,
    list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN (CASE WHEN i = 0 THEN -9223372036854775808::HUGEINT ELSE pow(2, 63 - i)::HUGEINT END) ELSE 0::HUGEINT END))::BIGINT AS hash
  FROM embeddings)"""


def sql(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body
