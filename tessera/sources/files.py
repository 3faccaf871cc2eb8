"""File operations through the cluster's own file systems, on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)
        self.root = self._path(root).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString().rstrip("/")

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isFile()

    def names(self, path: str) -> list[str]:
        """Names below a folder; none where it is missing."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))
