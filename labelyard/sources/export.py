"""Ordered CSV and JSON exports of any size, as parts that follow each other.

The parts of an export, put one behind the other in the order of its manifest, are one CSV file or
one JSON array. Every task writes its own range of rows; nothing passes through the driver but the
manifest, which has a row for each part. An export is written beside its place and moved there
when it is whole, manifest included, so readers see all of it or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import positions
from ..operators.validate import require_rows

#: Rows of one part at most.
PART_ROWS = 1_000_000
MANIFEST, BEGIN, END = "_manifest.json", "part-begin", "part-end"
CSV = {"escape": '"', "nullValue": "", "emptyValue": '""', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


class Folder:
    """The files of a path in whatever store Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.root = self.at(path)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.jvm = jvm

    def exists(self) -> bool:
        return self.fs.exists(self.root)

    def write(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.at(self.root, name), True)
        try:
            out.write(data)
        finally:
            out.close()

    def read(self, name: str) -> str:
        data = self.fs.open(self.at(self.root, name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def move(self, path: str) -> None:
        if not self.fs.rename(self.root, self.at(path)):
            raise OSError(f"can't move to {path}")

    def remove(self) -> None:
        self.fs.delete(self.root, True)


def _export(df: DataFrame, path: str, order: Sequence[str], line: Callable[[int], Column], begin: str, end: str, allow_empty: bool) -> None:
    spark = df.sparkSession
    if not allow_empty:
        require_rows(df)
    if Folder(spark, path).exists():
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}-unfinished-{uuid.uuid4().hex}"
    rows = positions(df, *order, name="_place")
    try:
        # partitions are in order and so are the numbers of their files
        rows.select(line(rows.count()).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", PART_ROWS).text(beside)
        folder = Folder(spark, beside)
        for name, text in ((BEGIN, begin), (END, end)):
            if text:
                folder.write(name, text.encode())
        files = spark.read.format("binaryFile").load(beside).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
        known = {r["name"]: r for r in files.collect()}
        body = sorted(n for n in known if n.startswith("part-") and n not in (BEGIN, END))
        parts = [{"name": n, "bytes": known[n]["length"], "sha256": known[n]["sha256"]} for n in (BEGIN, *body, END) if n in known]
        folder.write(MANIFEST, (json.dumps({"order": list(order), "parts": parts}, indent=2) + "\n").encode())
        folder.move(path)
    except BaseException:
        Folder(spark, beside).remove()
        raise


def ordered_csv(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] | None = None, allow_empty: bool = True) -> None:
    """``columns`` (None: all) of ``df`` in ``order`` as CSV parts: a byte order mark, a header, and
    quotes doubled inside quotes. Nulls are empty, empty texts are quoted. Rows that ``order`` doesn't
    tell apart follow in any order."""
    names = list(columns or df.columns)
    header = ",".join('"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\n\r') else n for n in names)
    line = F.to_csv(F.struct(*[F.col(n).cast("string").alias(n) for n in names]), CSV)
    _export(df, path, order, lambda total: line, "\ufeff" + header + "\n", "", allow_empty)


def ordered_json(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] | None = None, allow_empty: bool = True) -> None:
    """Records of ``columns`` (None: all) of ``df`` in ``order`` as parts of a JSON array: four
    spaces, other scripts kept, a line break at the end."""
    names = list(columns or df.columns)
    value = lambda n: F.regexp_extract(F.to_json(F.array(n)), r"(?s)^\[(.*)\]$", 1)
    fields = F.concat_ws(",\n", *[F.concat(F.lit(f"        {json.dumps(n, ensure_ascii=False)}: "), value(n)) for n in names])
    record = F.concat(F.lit("    {\n"), fields, F.lit("\n    }"))
    line = lambda total: F.concat(record, F.when(F.col("_place") < total - 1, ",").otherwise(""))
    _export(df, path, order, line, "[" if df.isEmpty() else "[\n", "]\n", allow_empty)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Folder(spark, path).read(MANIFEST))


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, problem) of parts that are missing, changed, or not in the manifest."""
    said = spark.createDataFrame([(p["name"], p["sha256"]) for p in manifest(spark, path)["parts"]], "name string, said string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "unknown").when(F.col("said") != F.col("found"), "changed")
    return said.join(files, "name", "full").select("name", problem.alias("problem")).filter("problem is not null")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an ordered CSV export with ``place``, their place in it from 0."""
    names = [p["name"] for p in manifest(spark, path)["parts"] if p["name"] not in (BEGIN, END)]
    if not names:
        return spark.createDataFrame([], schema).withColumn("place", F.lit(0).cast("long"))
    options = {k: v for k, v in CSV.items() if k not in ("emptyValue", "nullValue")}
    rows = spark.read.schema(schema).options(**options, multiLine=True, lineSep="\n", nullValue="").csv([f"{path}/{n}" for n in names])
    return positions(rows.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()}), "_file", "_row", name="place").drop("_file", "_row")


def joined(spark: SparkSession, path: str, to: str) -> None:
    """The export as one file, its parts copied one behind the other, a block at a time."""
    source, target = Folder(spark, path), Folder(spark, to)
    out = target.fs.create(target.root, True)
    try:
        for part in manifest(spark, path)["parts"]:
            from_ = source.fs.open(source.at(source.root, part["name"]))
            try:
                source.jvm.org.apache.hadoop.io.IOUtils.copyBytes(from_, out, 1 << 20, False)
            finally:
                from_.close()
    finally:
        out.close()
