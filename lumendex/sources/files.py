"""Small files through Hadoop's file system API, so that a store may lie wherever Spark writes."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self._conf)
        parsed = urlparse(self.root)
        self.local = parsed.path if parsed.scheme in ("", "file") and self.fs.getScheme() == "file" else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make_dir(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, folder: str) -> int:
        """Bytes of all files below a folder; 0 without it."""
        path = self._path(folder)
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def publish(self, name: str, data: bytes) -> bool:
        """Create a file with all its content at once, unless it is there already: False then.

        A complete temporary file is linked (local folders) or renamed (HDFS, where a rename never replaces) to the name.
        """
        temporary = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(temporary), False)
        stream.write(bytearray(data))
        stream.hsync() if self.local is None else None
        stream.close()
        if self.local is None:
            return not self.fs.exists(self._path(name)) and self.fs.rename(self._path(temporary), self._path(name))
        source, target = (os.path.join(self.local, n) for n in (temporary, name))
        try:
            with open(source, "rb") as f:
                os.fsync(f.fileno())
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            self.delete(temporary)
