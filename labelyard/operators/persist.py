"""Cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset, a
    temporary one does in a local session; on a cluster executors couldn't read it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder. For loops: a checkpoint passes on the
    estimated size of its plan, which a join of a table with itself squares in each round, while a
    written table has its own."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the table that ``written`` made for ``df``, which nothing may read any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[1].startswith("table-"):
            raise ValueError(f"{folder} isn't a written table")
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
