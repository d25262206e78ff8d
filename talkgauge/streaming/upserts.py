"""A table of the newest row per key, kept as a log of changes in hash buckets.

Each micro-batch writes the keys it changed, and nothing else, into a folder of its own, one subfolder
per bucket.  A commit record then names, for each bucket, the layers that make up the table: oldest
first, with the rows and files of each.  Only what the newest record names is ever read, so a micro-batch
that was written but not committed leaves no trace, and one that is repeated after its commit changes
nothing.  A file that a record names and that is gone raises an error.

Where a bucket's newest layer has grown to half of the one below, both are merged, so a bucket has a
number of layers, and a row a number of rewrites, that grow with the logarithm of its rows.  Layers that were merged stay
in place for readers of older records; `remove_unused` deletes what neither of the newest records names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from talkgauge.sources.commits import Folder

BUCKETS = 16
_EPOCH, _BUCKET = "_epoch", "upsert_bucket"


class UpsertLog:
    """The newest row of each key under a folder; null keys are keys like others."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS
    ) -> None:
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.folder = Folder(spark, path)
        self._stored = StructType([*schema.fields, StructField(_EPOCH, LongType())])

    def _records(self) -> list[str]:
        return [name for name in self.folder.names("commits") if name.endswith(".json")]

    def newest(self) -> dict | None:
        """The newest commit record, or None before the first."""
        names = self._records()
        if not names:
            return None
        record = self.folder.read(f"commits/{names[-1]}")
        if record["buckets"] != self.buckets or record["keys"] != self.keys:
            raise ValueError(
                f"{self.folder.path} has {record['buckets']} buckets by {record['keys']},"
                f" not {self.buckets} by {self.keys}"
            )
        return record

    def write(self, changed: DataFrame, epoch: int) -> bool:
        """Commit the changed rows of an epoch; False, and no change, if it is committed already."""
        record = self.newest()
        if record is None and epoch > 0:
            raise FileNotFoundError(f"no commit record in {self.folder.path}, but epoch {epoch} has begun")
        if record is not None and epoch <= record["epoch"]:
            return False
        layers = {} if record is None else dict(record["layers"])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        for name, layer in self._layer(changed.withColumn(_EPOCH, F.lit(epoch).cast("long")), epoch, bucket).items():
            layers[name] = [*layers.get(name, []), layer]
        layers |= self._merged(layers, epoch)
        entry = {"epoch": epoch, "buckets": self.buckets, "keys": self.keys, "layers": layers}
        return self.folder.create(f"commits/{epoch:012d}.json", entry)

    def _layer(self, rows: DataFrame, epoch: int, bucket) -> dict[str, dict]:
        """Write rows into a new folder; what it holds, per bucket."""
        name = f"data/{epoch:012d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, bucket).hint("rebalance", _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.folder.path}/{name}")
        found: dict[str, dict] = {}
        for file in self.folder.files(name):
            of = found.setdefault(file.split("/")[0].removeprefix(f"{_BUCKET}="), {"files": [], "rows": 0})
            of["files"].append(f"{name}/{file}")
        if found:  # from the footers
            counted = self._read([f for x in found.values() for f in x["files"]]).groupBy(bucket.alias("b")).count()
            for b, n in counted.collect():  # a row per bucket
                found[str(b)]["rows"] = n
        return found

    def _merged(self, layers: dict[str, list[dict]], epoch: int) -> dict[str, list[dict]]:
        """The layers of buckets whose last ones are merged."""
        kept, merge = {}, []
        for name, own in layers.items():
            n, rows = len(own) - 1, own[-1]["rows"]
            while n > 0 and own[n - 1]["rows"] < 2 * rows:
                n, rows = n - 1, rows + own[n - 1]["rows"]
            if n < len(own) - 1:
                kept[name] = own[:n]
                merge += [f for layer in own[n:] for f in layer["files"]]
        if not merge:
            return {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        made = self._layer(self._newest_rows(self._read(merge)), epoch, bucket)
        return {name: [*own, made[name]] for name, own in kept.items()}

    def _read(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self._stored).option("recursiveFileLookup", True)
        return reader.parquet(*[f"{self.folder.path}/{f}" for f in files])

    def _newest_rows(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self._stored.names if c not in self.keys]
        newest = F.max_by(F.struct(*others), _EPOCH).alias("_row")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*")

    def read(self) -> DataFrame:
        """The newest row of each key, as of the newest commit."""
        record = self.newest()
        layers = [] if record is None else [x for own in record["layers"].values() for x in own]
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        files = [f for layer in layers for f in layer["files"]]
        return self._newest_rows(self._read(files)).select(*self.schema.names)

    def remove_unused(self, keep: int = 2) -> list[str]:
        """Delete data that none of the last `keep` records names, and older records; the folders deleted.

        Data newer than the last record belongs to a micro-batch at work and stays.
        """
        names = self._records()
        records = [self.folder.read(f"commits/{name}") for name in names[-keep:]]
        if not records:
            return []
        used = {f.split("/")[1] for r in records for own in r["layers"].values() for x in own for f in x["files"]}
        last = records[-1]["epoch"]
        gone = [d for d in self.folder.names("data") if d not in used and int(d.split("-")[0]) <= last]
        for name in names[:-keep]:
            self.folder.remove(f"commits/{name}")
        for name in gone:
            self.folder.remove(f"data/{name}")
        return gone
