"""Readers: files, CSV and JSON tables with fixed schemas, detection streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import casefold
from ..operators.manifest import last_of_key, ranks
from ..operators.validate import duplicate_keys, outside_domain, require, require_rows

IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
LABELS = T.StructType([T.StructField("filename", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("label", T.StringType())])
DETECTIONS = T.StructType([
    T.StructField("detection_id", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("source_assets", T.ArrayType(T.StringType())), T.StructField("task_type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("mask_ref", T.StringType()), T.StructField("observed_at", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("score_type", T.StringType()),
    T.StructField("model", T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])), T.StructField("evidence_refs", T.ArrayType(T.StringType())), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """(path, filename, length[, content]) of files below ``root`` by suffix in any case. Content
    isn't read unless asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).withColumn("filename", basename("path"))
    return rows.select("path", "filename", "length", *(["content"] if content else []))


def file_candidates(files: DataFrame) -> DataFrame:
    """(filename, n_paths, first_path): places of each name; ``paths_of_names`` has every one."""
    return files.groupBy("filename").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))


def paths_of_names(files: DataFrame) -> DataFrame:
    """(filename, path, rank, rank_n): every path of each name with its place among them, as rows,
    so that a name with very many paths isn't one list."""
    return ranks(files.select("filename", "path"), ["filename"], "path")


def folded(name: Column | str) -> Column:
    """``name`` without case, by full folding."""
    return casefold(name)


def unique_files(files: DataFrame) -> DataFrame:
    """files with names that are unique whatever the case; raises otherwise or if there are none."""
    require_rows(files)
    require(duplicate_keys(files, folded("filename").alias("name")), "file name occurs twice")
    return files.orderBy(folded("filename"), "path")


def digests(files: DataFrame) -> DataFrame:
    """files (with content) with their sha256, and without the content."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def decoded_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, image_ok) by the image source; an undecodable file isn't an error."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    ok = F.col("image.width") > 0
    return rows.select(F.col("image.origin").alias("path"), F.when(ok, F.col("image.width")).alias("width"), F.when(ok, F.col("image.height")).alias("height"), ok.alias("image_ok"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with header, quotes doubled inside quotes and line breaks in them; a byte order
    mark is dropped."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def json_labels(spark: SparkSession, path: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Label records of a JSON array; raises on repeated names, or labels that aren't allowed."""
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path)
    require(duplicate_keys(rows, "filename"), "label for a file occurs twice")
    if allowed is not None:
        require(outside_domain(rows, "label", allowed), "label isn't allowed")
    return rows


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array with their ``position`` in it."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("position", "r")).select("position", "r.*")


def keyed_manifest(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "filename") -> DataFrame:
    """A CSV manifest with one row for each key: the last. Blank keys go."""
    return last_of_key(csv_table(spark, path, schema).withColumn("_row", F.monotonically_increasing_id()), key, "_row").drop("_row")


def scene_groups(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "filename", group: str = "scene_group") -> DataFrame:
    """A CSV manifest of scene groups with one row for each key, the last; raises if a key's group
    is blank or missing."""
    rows = keyed_manifest(spark, path, schema, key)
    require(rows.filter(F.coalesce(F.trim(group), F.lit("")) == ""), f"{group} is blank")
    return rows


def enabled(index: DataFrame) -> DataFrame:
    """Rows whose training_use says true in any case."""
    return index.filter(F.lower(F.col("training_use").cast("string")) == "true")


def detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).json(path)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(type, geometry JSON, properties) of a feature collection. Geometries of any kind keep their
    coordinates, as they stay JSON text; a null geometry is null."""
    rows = spark.read.option("multiLine", True).schema("features array<struct<type:string,geometry:string,properties:map<string,string>>>").json(path)
    return rows.select(F.explode("features").alias("f")).select("f.type", "f.geometry", "f.properties")


def layers(spark: SparkSession, root: str, suffix: str = "_cog.tif") -> DataFrame:
    """(name, path) of raster layers in a folder."""
    rows = spark.read.format("binaryFile").load(root).select("path", basename("path").alias("filename")).filter(F.col("filename").endswith(suffix))
    return rows.select(F.expr(f"left(filename, length(filename) - {len(suffix)})").alias("name"), "path")
