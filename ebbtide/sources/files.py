"""Small files in any store that Spark's Hadoop layer reaches. create() never overwrites: that is what commits rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ebbtide.errors import Conflict


#: Where a file appears whole when it is closed, and only if none is there.
OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Makes the file with all its content at once, or raises Conflict if it is there. A writer that dies leaves at most a file that nobody
        reads beside it. A local store links the finished file into place; an object store makes a file visible as a whole when it
        is closed, on condition that there is none; others rename on that condition."""
        import uuid

        scheme, target, data = self._fs.getUri().getScheme(), self._path(name), bytearray(text.encode())
        beside = target if scheme in OBJECT_STORES else self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        try:
            if self._fs.exists(target):
                raise Conflict(f"{name} exists already")
            stream = self._fs.create(beside, False)
            try:
                stream.write(data)
            finally:
                stream.close()
            if scheme == "file":
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            elif beside is not target:
                none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(beside, target, none)
        except Conflict:
            raise
        except Exception as e:
            raise Conflict(f"{name}: {e}") from e
        finally:
            if beside is not target:
                self._fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
