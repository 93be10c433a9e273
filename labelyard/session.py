"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "labelyard", **settings: str) -> SparkSession:
    """The running session, or a new one; ``settings`` override, with `__` for `.`."""
    given = {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=SETTINGS | given).getOrCreate()
