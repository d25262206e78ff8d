"""Writers.  Tables are laid out by batch, so later reads prune by `batch_id`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.operators import results as result_ops
from talkgauge.sources import documents
from talkgauge.sources.commits import Folder


TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CSV_FILE_ROWS = 1_000_000


def _by_folder(df: DataFrame, *folders: str) -> DataFrame:
    """Gather rows per folder for few, even files; Spark splits a folder that is too large."""
    return df.hint("rebalance", *folders)


def write_results_ndjson(
    results: DataFrame,
    path: str,
    exported_at: Column,
    batch_id: str | None = None,
    keep_nulls: bool = False,
) -> None:
    """One JSON object per line, in `batch=...` folders; rows' own values win.

    The batch id is in the folder name and in each record.  Absent fields are left out;
    `keep_nulls` writes them as null.
    """
    stamped = result_ops.stamp_export(results, batch_id, exported_at)
    foldered = stamped.withColumn("batch", F.col("batch_id"))
    writer = _by_folder(foldered, "batch").write.partitionBy("batch")
    writer.option("ignoreNullFields", not keep_nulls).option(
        "timestampNTZFormat", TIMESTAMPS
    ).mode("append").json(path)


def write_results_csv(
    results: DataFrame, path: str, prompt_version: str = c.DEFAULT_PROMPT_VERSION
) -> bool:
    """The ten-column CSV with header; writes nothing, and returns False, without rows."""
    return _write_csv(result_ops.csv_rows(results, prompt_version), path)


def _write_csv(rows: DataFrame, path: str) -> bool:
    """Rows are written beside the target and counted on the way; the files move only if there are rows.

    Files are limited in rows, since CSV with line breaks in cells is read a file at a time.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    folder = Folder(rows.sparkSession, parent)
    staging = f"_staging-{uuid.uuid4().hex}-{name}"  # readers of the parent skip it
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        writer = counted.write.option("header", True).option("escape", '"')
        writer.option("maxRecordsPerFile", CSV_FILE_ROWS).csv(f"{parent}/{staging}")
        if not seen.get["rows"]:
            return False
        if folder.exists(name):
            for file in folder.files(staging):
                folder.move(f"{staging}/{file}", f"{name}/{file}")
        else:
            folder.move(staging, name)
        return True
    finally:
        folder.remove(staging)


def write_export(
    results: DataFrame, path: str, file_format: str, export_ts: str, exported_at: Column
) -> None:
    """A dated export in `batch_id=.../export_ts=...` folders, as NDJSON or CSV."""
    dated = results.withColumn("export_ts", F.lit(export_ts))
    if file_format == "ndjson":
        rows = result_ops.stamp_export(dated, None, exported_at)
    elif file_format == "csv":
        rows = dated.select("batch_id", "export_ts", *result_ops.csv_columns(dated))
    else:
        raise ValueError(f"Unsupported file format: {file_format}")
    writer = _by_folder(rows, "batch_id").write.partitionBy("batch_id", "export_ts").mode("append")
    if file_format == "ndjson":
        writer.option("timestampNTZFormat", TIMESTAMPS).json(path)
    else:
        writer.option("header", True).option("escape", '"').csv(path)


def write_document(lines: DataFrame, path: str) -> str:
    """The lines of one JSON document per batch (a summary or a result envelope); the name of this writing.

    Rows are range-partitioned and sorted, so the files of a `batch_id=...` folder, read
    in name order, are the document; a large batch simply takes more files.  They are listed in a manifest,
    `documents.read_document` and `documents.damaged_parts` go by it.
    """
    order = ["batch_id", "section", "position"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("batch_id", "line")
        .write.partitionBy("batch_id")
        .option("maxRecordsPerFile", documents.PART_LINES)
        .mode("append")
        .text(path)
    )
    return documents.write_manifest(lines.sparkSession, path)


def write_summary_csv(results: DataFrame, path: str) -> bool:
    """The existing summary columns as CSV; nothing without rows."""
    return _write_csv(result_ops.summary_columns(results), path)


def append_logs(records: DataFrame, path: str, at: str = "timestamp") -> None:
    """Append log records as JSON lines under `log_date=...` folders."""
    dated = records.withColumn("log_date", F.to_date(at))
    writer = _by_folder(dated, "log_date").write.partitionBy("log_date").mode("append")
    writer.option("timestampNTZFormat", TIMESTAMPS).json(path)
