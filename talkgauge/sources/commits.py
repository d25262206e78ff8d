"""Small files that are written once: commit records and manifests beside the data they name.

All access goes through Hadoop's file systems, so it works wherever Spark's readers and writers do.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Names of what lies in a subfolder, in order; none if it is not there."""
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name)))

    def files(self, name: str = "") -> dict[str, int]:
        """Bytes of all files below a subfolder, by their path below it; hidden ones are left out."""
        found, prefix = {}, self._at(name).toUri().getPath().rstrip("/") + "/"
        if not self.exists(name):
            return found
        listed = self._fs.listFiles(self._at(name), True)
        while listed.hasNext():
            entry = listed.next()
            below = entry.getPath().toUri().getPath().removeprefix(prefix)
            if not any(part.startswith(("_", ".")) for part in below.split("/")):
                found[below] = entry.getLen()
        return found

    def read(self, name: str) -> Any:
        """The JSON value in a file."""
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: Any) -> bool:
        """Write a JSON value into a new file, whole or not at all; False if the file is there already."""
        if self.exists(name):
            return False
        draft = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        self._fs.mkdirs(draft.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        stream.close()
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._at(name), options)  # fails if another writer was faster
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        """Rename a file or folder inside this folder; what is in the way is an error."""
        if self.exists(to):
            raise FileExistsError(f"{self.path}/{to}")
        self._fs.mkdirs(self._at(to).getParent())
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"could not rename {self.path}/{name} to {to}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
