"""Small things done to files of a shared folder through Hadoop's file system, on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none where there is no folder."""
        at, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that is there whole or not at all; false where one of that name is there already."""
        at, fs = self._at(path)
        draft, _ = self._at(f"{path}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not fs.exists(at) and fs.rename(draft, at)
