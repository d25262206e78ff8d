"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set the SQL options that decide results and one join choice; sizing is the cluster's.

    JSON objects with a repeated key keep the last one, and naive timestamps are
    read and written in UTC.  Joins may hash instead of sort when every partition of one
    side has been measured to be small, which spares sorting message texts.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder that the session names.

    Only a local session that names none (a test) falls back to a temporary folder; on a
    cluster each executor would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="talkgauge-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
