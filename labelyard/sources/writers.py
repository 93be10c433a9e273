"""Writers: datasets by Spark, and small contract files as one file."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import require_rows

#: Rows that a single contract file may have; larger results are written as datasets.
FILE_ROWS = 200_000


def csv_dataset(df: DataFrame, path: str, columns: Sequence[str], allow_empty: bool = True) -> None:
    """``columns`` of df as CSV files with headers; others are left out."""
    if not allow_empty:
        require_rows(df)
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _small(df: DataFrame) -> list:
    rows = df.limit(FILE_ROWS + 1).collect()
    if len(rows) > FILE_ROWS:
        raise ValueError(f"more than {FILE_ROWS} rows for one file")
    return rows


def atomic_text(text: str, path: str) -> None:
    """Writes beside the place and moves there, so that no half file is ever seen."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def csv_file(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] | None = None) -> None:
    """``columns`` (None: all) of a small table as one CSV file with a byte order mark; others may
    serve as ``order`` and are left out."""
    import io

    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns or df.columns)
    writer.writerows(_small(df.orderBy(*order).select(*columns or df.columns)))
    atomic_text("\ufeff" + out.getvalue(), path)


def json_list_file(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str]) -> None:
    """Records as a JSON array: four spaces, other scripts kept, a line break at the end."""
    rows = [{c: r[c] for c in columns} for r in _small(df.orderBy(*order))]
    atomic_text(json.dumps(rows, ensure_ascii=False, indent=4) + "\n", path)


def json_report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    atomic_text(json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str) + "\n", path)


def markdown_table(df: DataFrame, order: Sequence[str]) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _small(df.orderBy(*order))]) + "\n"


def sidecar(path: str) -> str:
    """Writes the file's sha256 beside it and returns it."""
    state = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            state.update(block)
    atomic_text(f"{state.hexdigest()}  {os.path.basename(path)}\n", path + ".sha256")
    return state.hexdigest()


def prediction_columns(df: DataFrame, labels: Sequence[str], form: str = "%.9f", prefix: str = "prob_") -> DataFrame:
    """filename and a formatted probability column for each label."""
    return df.select("filename", *[F.format_string(form, F.get("probs", F.lit(i))).alias(prefix + x) for i, x in enumerate(labels)])


def fold_predictions(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The columns of a fold's prediction file from rows (filename, fold, true_id, pred_id, logits,
    probs): key columns, labels by id and by name, logit_ and prob_ columns."""
    names = F.array(*[F.lit(x) for x in labels])
    keys = [c for kind in ("true", "pred") for c in (F.col(f"{kind}_id").alias(f"{kind}_label_id"), F.get(names, F.col(f"{kind}_id")).alias(f"{kind}_label"))]
    return df.select("filename", "fold", *keys, *[F.get(of, F.lit(i)).alias(prefix + x) for of, prefix in (("logits", "logit_"), ("probs", "prob_")) for i, x in enumerate(labels)])


def probability_array(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds ``probs`` from columns that begin with prob_ or p_."""
    for prefix in ("prob_", "p_"):
        if all(prefix + x in df.columns for x in labels):
            return df.withColumn("probs", F.array(*[F.col(prefix + x).cast("double") for x in labels]))
    raise ValueError("no probability columns")
