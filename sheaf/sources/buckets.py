"""Tables that are merged into bucket by bucket.

Rows lie in Parquet folders by the hash of a key. A merge reads and writes the buckets that its batch
touches; the others keep their files. Which folder holds a bucket stands in a commit file, so a
merge is seen whole or not at all, and one that broke off leaves nothing but files that no commit names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sheaf.sources.files import Files


class BucketTable:
    """A table at ``path``; ``key`` names the columns by whose hash rows are dealt to ``buckets`` folders.

    One writer at a time. ``buckets`` is fixed when the table is created: a bucket should be some
    hundred MB at most, as a merge rewrites it whole. Rows with a null in the key are in bucket 0."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, Files(spark)

    def _head(self) -> dict:
        last = [n for n in self.files.names(f"{self.path}/commits") if n.isdigit()][-1]
        return json.loads(self.files.read(f"{self.path}/commits/{last}"))

    def bucket_of(self, buckets: int) -> Column:
        some_null = F.lit(False)
        for k in self.key:
            some_null = some_null | F.col(k).isNull()
        return F.when(some_null, 0).otherwise(F.pmod(F.xxhash64(*self.key), F.lit(buckets))).cast("int")

    def _write(self, rows: DataFrame, version: int, buckets: int) -> set[int]:
        """Writes rows as folders of ``version`` and returns the buckets that have any."""
        folder = f"{self.path}/data/v={version}"
        rows.withColumn("bucket", self.bucket_of(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return {int(n.removeprefix("bucket=")) for n in self.files.names(folder) if n.startswith("bucket=")}

    def _commit(self, head: dict) -> None:
        if not self.files.publish(f"{self.path}/commits/{head['version']:012d}", json.dumps(head)):
            raise RuntimeError(f"version {head['version']} of {self.path} has been written by another")

    def create(self, rows: DataFrame, buckets: int = 64) -> "BucketTable":
        """The first version. Where the table is there already, nothing is done."""
        if not self.files.names(f"{self.path}/commits"):
            found = self._write(rows, 0, buckets)
            self._commit({"version": 0, "buckets": buckets, "folders": {b: 0 for b in sorted(found)}, "batches": [], "schema": rows.schema.json()})
        return self

    def _rows(self, head: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(head["schema"]))
        places = [f"{self.path}/data/v={v}/bucket={b}" for b, v in head["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows of the last version; bucket and version folders are not among the columns."""
        return self._rows(self._head())

    def has(self, batch_id: int) -> bool:
        """Whether a batch of that number has been merged, of the last thousand that had one."""
        return batch_id in self._head()["batches"]

    def touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` (with the key) belong to."""
        head = self._head()
        return self._rows(head, {r["bucket"] for r in rows.select(self.bucket_of(head["buckets"]).alias("bucket")).distinct().collect()})

    def folders(self) -> dict[int, int]:
        """In which version each bucket was last written."""
        return {int(b): v for b, v in self._head()["folders"].items()}

    def merge(self, batch: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int | None = None, also: DataFrame | None = None) -> list[int]:
        """Replaces the buckets that ``batch`` touches by ``rule(stored, batch)``; returns those that have changed.

        ``rule`` sees the touched buckets only, so it has to be one by the key: what it makes of a
        row must depend on no rows of other keys. ``also`` has further rows with the key, whose
        buckets are opened too. A ``batch_id`` that has been merged does nothing. A bucket in which
        every row comes out as it was keeps its files."""
        head = self._head()
        if batch_id is not None and batch_id in head["batches"]:
            return []
        buckets, version = head["buckets"], head["version"] + 1
        keys = batch.select(self.bucket_of(buckets).alias("bucket"))
        keys = keys if also is None else keys.union(also.select(self.bucket_of(buckets)))
        touched = {r["bucket"] for r in keys.distinct().collect()}  # as many as there are buckets at most
        stored = self._rows(head, touched)
        found = self._write(rule(stored, batch).select(*stored.columns), version, buckets)

        def digest(rows: DataFrame) -> dict[int, tuple]:
            mark = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
            return {r[0]: tuple(r[1:]) for r in rows.groupBy(self.bucket_of(buckets).alias("bucket")).agg(F.count(F.lit(1)), mark).collect()}

        now = {**{b: head["folders"][b] for b in head["folders"] if int(b) not in touched}, **{str(b): version for b in found}}
        before, after = digest(stored), digest(self._rows({**head, "folders": {b: v for b, v in now.items() if v == version}}))
        same = {b for b in touched if before.get(b) == after.get(b)}
        for b in same:
            now.pop(str(b), None)
            if str(b) in head["folders"]:
                now[str(b)] = head["folders"][str(b)]
        if touched - same or batch_id is not None:
            self._commit({**head, "version": version, "folders": now, "batches": (head["batches"] + ([] if batch_id is None else [batch_id]))[-1000:]})
        return sorted(touched - same)

    def vacuum(self) -> None:
        """Deletes folders that the last commit does not name, and the commits before it."""
        head = self._head()
        used = {f"v={v}/bucket={b}" for b, v in head["folders"].items()}
        for v in self.files.names(f"{self.path}/data"):
            names = [b for b in self.files.names(f"{self.path}/data/{v}") if b.startswith("bucket=")]
            if not any(f"{v}/{b}" in used for b in names):
                self.files.delete(f"{self.path}/data/{v}")
                continue
            for b in names:
                if f"{v}/{b}" not in used:
                    self.files.delete(f"{self.path}/data/{v}/{b}")
        for c in self.files.names(f"{self.path}/commits"):
            if c != f"{head['version']:012d}":
                self.files.delete(f"{self.path}/commits/{c}")
