"""Small files and folders in whatever file system Spark's paths name."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Driver-side access by the file system that the path itself names."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: object):
        return self._jvm.org.apache.hadoop.fs.Path(str(path))

    def _of(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, path: object) -> bool:
        p = self._path(path)
        return self._of(p).exists(p)

    def names(self, path: object) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        p = self._path(path)
        fs = self._of(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: object) -> str:
        p = self._path(path)
        stream = self._of(p).open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: object, text: str) -> None:
        """Put a text in place by one rename, so readers see the old one or the new one."""
        p = self._path(path)
        beside = self._path(f"{p.getParent()}/.{p.getName()}.{uuid.uuid4().hex}")
        fs = self._of(p)
        fs.mkdirs(p.getParent())
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        self.rename(beside, p)

    def create(self, path: object, text: str) -> bool:
        """Write a new file; False if there is one already."""
        p = self._path(path)
        fs = self._of(p)
        fs.mkdirs(p.getParent())
        if not fs.createNewFile(p):
            return False
        self.write(path, text)
        return True

    def rename(self, old, new) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._of(self._path(new)).getUri(), self._conf)
        option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE
        context.rename(self._path(old), self._path(new), how)

    def delete(self, path: object) -> None:
        p = self._path(path)
        self._of(p).delete(p, True)
