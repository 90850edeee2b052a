"""S-23: files in any store that Hadoop reaches (``file:``, ``s3a:``, ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """push, pull, exists, list and replace; the scheme of a path chooses the connector."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.base = base

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def push(self, local: str, path: str) -> None:
        self._fs(path).copyFromLocalFile(False, True, self._path(local), self._path(path))

    def pull(self, path: str, local: str) -> None:
        self._fs(path).copyToLocalFile(False, self._path(path), self._path(local), True)

    def list(self, prefix: str) -> list[str]:
        found = self._fs(prefix).globStatus(self._path(prefix + "*")) or []
        return sorted(x.getPath().toString() for x in found)

    def replace(self, new: str, old: str) -> None:
        """new takes old's place; old is moved away first, so that one of them is always there."""
        fs = self._fs(old)
        away = self._path(old + ".old")
        fs.delete(away, True)
        if fs.exists(self._path(old)):
            fs.rename(self._path(old), away)
        fs.rename(self._path(new), self._path(old))
        fs.delete(away, True)


    def commit(self, stage: str, path: str) -> None:
        """stage becomes path in one rename; an error, and stage gone, if path is taken."""
        fs = self._fs(path)
        if fs.exists(self._path(path)) or not fs.rename(self._path(stage), self._path(path)):
            fs.delete(self._path(stage), True)
            raise FileExistsError(path)


class NullStore:
    """Keeps nothing."""

    def exists(self, path: str) -> bool:
        return False

    def push(self, local: str, path: str) -> None:
        return None

    def pull(self, path: str, local: str) -> None:
        raise FileNotFoundError(path)

    def list(self, prefix: str) -> list[str]:
        return []
