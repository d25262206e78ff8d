"""Result files: NDJSON and CSV, and listings of the files themselves."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import schemas

TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_LISTING = "path STRING, modificationTime TIMESTAMP, length BIGINT"


def read_results_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One result per line; blank lines are skipped, one bad line fails the load."""
    rows = (
        spark.read.schema(schemas.RESULT)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", TIMESTAMPS)
        .json(path)
    )
    return rows.drop("batch")  # the folder's name, when this library wrote the files


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results from a CSV with header, under the names of the NDJSON fields.

    Columns are taken by their names, `turns` and `start_ts` for `total_turns` and
    `start_time`; absent ones are NULL.  Numbers may be written as `2.0`; a cell that is not
    empty and does not convert fails the load.
    """
    cells = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", False)
        .csv(path)
    )
    own = {"total_turns": "turns", "start_time": "start_ts"}

    def value(name: str, type_name: str) -> Column:
        found = next((n for n in (name, own.get(name)) if n in cells.columns), None)
        if found is None:
            return F.lit(None).cast(type_name)
        cell = F.nullif(F.trim(f"`{found}`"), F.lit(""))
        if type_name == "STRING":
            return F.col(f"`{found}`")
        read = cell.try_cast("double" if type_name in ("INT", "DOUBLE") else type_name)
        bad = read.isNull()
        if type_name == "INT":
            bad = bad | (read != F.floor(read))
        message = F.concat(F.lit(f"{found} is not {type_name}: "), cell)
        return F.when(cell.isNotNull() & bad, F.raise_error(message).cast(type_name)).otherwise(
            read.cast(type_name)
        )

    fields = [field.strip().split(" ") for field in schemas.RESULT_CSV.split(",")]
    return cells.select(*[value(name, type_name).alias(name) for name, type_name in fields])


def load_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result files of either format in one row type, chosen by the end of each path."""
    readers = {".ndjson": read_results_ndjson, ".csv": read_results_csv}
    loaded: DataFrame | None = None
    for path in paths:
        reader = next((r for end, r in readers.items() if path.rstrip("/").endswith(end)), None)
        if reader is None:
            raise ValueError(f"Unsupported file format: {path}")
        rows = reader(spark, path)
        loaded = rows if loaded is None else loaded.unionByName(rows, allowMissingColumns=True)
    if loaded is None:
        raise ValueError("no result files given")
    return loaded


def list_result_files(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """Files under `path`, newest first; file contents are never read.

    A folder that cannot be read gives no rows.  `batch_id` keeps files whose path below
    `path` contains it.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .select("path", "modificationTime", "length")
        )
    except AnalysisException:
        files = spark.createDataFrame([], _LISTING)
    listed = files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("filepath"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    if batch_id:
        listed = listed.filter(_below(path).contains(batch_id))
    return listed.orderBy(F.desc("modified_at"), F.desc("filepath"))


def _below(path: str) -> Column:
    """The named part of `filepath` below a folder.

    Spark gives part files random names, which say nothing about a batch.
    """
    below = F.substring_index("filepath", path.rstrip("/") + "/", -1)
    return F.regexp_replace(below, r"(^|/)part-\d+-[^/]*$", "")


def logs_for_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """Log lines of the files whose path below `path` contains the batch id.

    With logs stored in `batch_id=...` folders, the filter on the file path is answered
    from the file listing and other folders are not opened.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    located = lines.select("value", F.col("_metadata.file_path").alias("filepath"))
    return located.filter(_below(path).contains(batch_id)).select("value")


def latest_export(files: DataFrame) -> DataFrame:
    """The newest export of each batch and format.

    `files` is a listing whose paths hold `batch_id=<id>/export_ts=<stamp>` folders below
    a folder that ends in the format.
    """
    path = F.col("filepath")
    located = files.select(
        F.regexp_extract(path, r"/batch_id=([^/]+)/", 1).alias("batch_id"),
        F.regexp_extract(path, r"\.(ndjson|csv)/", 1).alias("format"),
        F.regexp_extract(path, r"/export_ts=([^/]+)/", 1).alias("export_ts"),
        "modified_at",
    ).filter((F.col("batch_id") != "") & (F.col("format") != "") & (F.col("export_ts") != ""))
    return located.groupBy("batch_id", "format").agg(
        F.max_by("export_ts", F.struct("modified_at", "export_ts")).alias("export_ts")
    )
