"""Manifests of JSON documents that lie in several files: which parts, in which order, how long, with which digest.

Each writing adds a table of the parts that no earlier one lists, and a record that commits it.  A batch's
document is what the newest writing that has the batch lists.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgauge.sources.commits import Folder

# Lines of one file; a reader holds a file at a time.
PART_LINES = 100_000
_FOLDER = "_manifest"
_PARTS = "batch_id STRING, part INT, file STRING, bytes BIGINT, sha256 STRING, writing INT"


class DamagedDocument(Exception):
    """A part of a document is missing or is not what the manifest says."""


def _found(spark: SparkSession, path: str) -> DataFrame:
    """The parts that are there, from their contents, by batch folder and file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    below = F.regexp_extract("path", r"(batch_id=[^/]*/[^/]*)$", 1)
    return files.filter(F.col("path").rlike(r"/batch_id=[^/]*/part-[^/]*$")).select(
        below.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def _writings(folder: Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names(f"{_FOLDER}/commits") if n.endswith(".json"))


def _listed(spark: SparkSession, path: str, writings: list[int]) -> DataFrame:
    if not writings:
        return spark.createDataFrame([], _PARTS)
    table = spark.read.schema(_PARTS).json(*[[f"{path}/{_FOLDER}/parts-{n:06d}" for n in writings]])
    return table


def _batch_folder(column: str):
    """The value in a `batch_id=...` folder's name, its escapes undone; null for Spark's name of null."""
    name = F.regexp_extract(column, r"^batch_id=([^/]*)/", 1)
    # only percent signs are escapes here, a plus sign is itself
    text = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name != "__HIVE_DEFAULT_PARTITION__", text)


def write_manifest(spark: SparkSession, path: str) -> str:
    """List the parts that no committed manifest lists yet; the name of this writing."""
    path = path.rstrip("/")
    folder = Folder(spark, path)
    before = _writings(folder)
    number = before[-1] + 1 if before else 0
    listed = _listed(spark, path, before).select("file")
    new = _found(spark, path).join(listed, "file", "left_anti") if folder.exists() else _listed(spark, path, [])
    in_order = Window.partitionBy("batch_id").orderBy("file")
    parts = new.withColumn("batch_id", _batch_folder("file")).withColumn("part", F.row_number().over(in_order) - 1)
    table = parts.select("batch_id", "part", "file", "bytes", "sha256", F.lit(number).alias("writing"))
    table.write.option("ignoreNullFields", False).mode("overwrite").json(f"{path}/{_FOLDER}/parts-{number:06d}")
    if not folder.create(f"{_FOLDER}/commits/{number:06d}.json", {"writing": number}):
        raise FileExistsError(f"{path}: another writing took the number {number}")
    return f"{number:06d}"


def document_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of each batch's newest document: batch_id, part, file, bytes, sha256, writing."""
    path = path.rstrip("/")
    listed = _listed(spark, path, _writings(Folder(spark, path)))
    newest = listed.groupBy("batch_id").agg(F.max("writing").alias("writing"))
    same = F.col("l.batch_id").eqNullSafe(F.col("n.batch_id")) & (F.col("l.writing") == F.col("n.writing"))
    return listed.alias("l").join(newest.alias("n"), same).select("l.*")


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts of the newest documents that are missing or changed: batch_id, part, file and problem."""
    listed = document_parts(spark, path)
    there = _found(spark, path).withColumnRenamed("bytes", "_bytes").withColumnRenamed("sha256", "_sha256")
    problem = F.when(F.col("_sha256").isNull(), "missing").when(F.col("sha256") != F.col("_sha256"), "changed")
    compared = listed.join(there, "file", "left").withColumn("problem", problem)
    return compared.filter(F.col("problem").isNotNull()).select("batch_id", "part", "file", "problem")


def read_document(spark: SparkSession, path: str, batch_id: str | None) -> Iterator[str]:
    """The text of a batch's document, a part at a time, in order; a gap or a changed part raises."""
    path = path.rstrip("/")
    parts = document_parts(spark, path).filter(F.col("batch_id").eqNullSafe(F.lit(batch_id))).orderBy("part")
    expected = 0
    for row in parts.toLocalIterator():
        if row.part != expected:
            raise DamagedDocument(f"{batch_id}: part {expected} is not in the manifest")
        if not Folder(spark, path).exists(row.file):
            raise DamagedDocument(f"{batch_id}: part {row.part}, {row.file}, is missing")
        content = spark.read.format("binaryFile").load(f"{path}/{row.file}").select("content", F.sha2("content", 256).alias("d"))
        found = content.first()
        if found.d != row.sha256:
            raise DamagedDocument(f"{batch_id}: part {row.part}, {row.file}, has changed")
        expected += 1
        yield bytes(found.content).decode()
    if not expected:
        raise DamagedDocument(f"no document of {batch_id}")
