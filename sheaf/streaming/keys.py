"""What a deduplicating stream remembers: keys of stored articles, in a folder for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheaf.functions import text as tx
from sheaf.sources.files import Files

SCHEMA = "content_hash string, url string, created_at timestamp, published_at timestamp, day date, batch_id long"


def keys_of(articles: DataFrame) -> DataFrame:
    """content_hash, url and dates of articles; ``day`` is the later date, up to which they are looked at."""
    day = F.to_date(F.greatest("created_at", "published_at"))
    return articles.select(tx.content_hash(F.col("title"), F.col("url")).alias("content_hash"), "url", "created_at", "published_at", day.alias("day"))


class KeyDays:
    """Keys at ``path``, by day and the batch that stored them. Rows are a set: what stands there twice counts once.

    A batch reads the days of its horizon and no other, so what it reads does not grow with the
    history. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def write(self, keys: DataFrame, batch_id: int) -> None:
        """Replaces what the batch has written before; a batch that writes nothing replaces nothing."""
        rows = keys.withColumn("batch_id", F.lit(batch_id).cast("long")).filter("day IS NOT NULL")
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(self.path)

    def read(self, cutoff: Column, before: int | None = None) -> DataFrame:
        """Keys of the day of ``cutoff`` and later, stored by batches before ``before``."""
        if not self.files.names(self.path):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("day") >= F.to_date(cutoff))
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def compact(self, cutoff: Column, before: int) -> None:
        """Deletes the days before ``cutoff`` and makes one folder of each later day's batches before ``before``.

        The new folder is there before the old ones go, so a run that breaks off leaves keys twice,
        not missing. Its number is negative: -2 less the last batch it has."""
        first = str(self.spark.range(1).select(F.to_date(cutoff)).first()[0])
        for name in [n for n in self.files.names(self.path) if n.startswith("day=")]:
            day = name.removeprefix("day=")
            if day < first or day == "__HIVE_DEFAULT_PARTITION__":
                self.files.delete(f"{self.path}/{name}")
                continue
            old = [int(b.removeprefix("batch_id=")) for b in self.files.names(f"{self.path}/{name}") if b.startswith("batch_id=")]
            old = [b for b in old if b < before]
            last = max([b if b >= 0 else -2 - b for b in old], default=-1)
            if len(old) < 2:
                continue
            if not self.files.exists(f"{self.path}/{name}/batch_id={-2 - last}/_SUCCESS"):  # else broken off after writing
                whole = [f"{self.path}/{name}/batch_id={b}" for b in old if b != -2 - last]
                rows = self.spark.read.schema("content_hash string, url string, created_at timestamp, published_at timestamp").parquet(*whole)
                rows.distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={-2 - last}")
            for b in [b for b in old if b != -2 - last]:
                self.files.delete(f"{self.path}/{name}/batch_id={b}")
