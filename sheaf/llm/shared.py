"""What the operators of this subpackage have in common: tables in the shared folder, the word pattern, packed texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.sources.stage import shared_path, shared_root, staged  # noqa: F401

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, packed: the texts in Zstandard, so that a join by doc_id moves a third of the bytes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in it:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                packed = [z.compress(t.encode()) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, packed binary")
