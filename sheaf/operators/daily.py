"""Daily partial figures that are kept and merged, so that a day that is run again touches one day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.operators.reports import n_rows, ratio
from sheaf.sources.files import Files

KEYS = ["day", "chat_id"]
SUMS = ["results", "delivered", "failed", "relevant"]


def day_partials(results: DataFrame, relevant_from: float = 0.3) -> DataFrame:
    """day, chat_id, sums of results, and a sketch of the distinct articles. results: article_id, chat_id,
    ai_relevance_score, processed_at, delivered, failed (of the delivered ones). A null time is a day of its own."""
    day = F.date_format("processed_at", "yyyy-MM-dd").alias("day")
    return results.groupBy(day, "chat_id").agg(
        n_rows().alias("results"), F.count_if("delivered").alias("delivered"), F.count_if(F.col("delivered") & F.col("failed")).alias("failed"),
        F.count_if(F.col("ai_relevance_score") >= relevant_from).alias("relevant"), F.hll_sketch_agg("article_id").alias("articles"))


def write_days(partials: DataFrame, path: str) -> None:
    """Replaces the days that ``partials`` has; the others keep their files."""
    partials.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Partials of days from ``first`` to ``last``; only their folders are read."""
    schema = "chat_id string, results long, delivered long, failed long, relevant long, articles binary, day string"
    if not Files(spark).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    rows = rows if first is None else rows.filter(F.col("day") >= first)
    return rows if last is None else rows.filter(F.col("day") <= last)


def merged(partials: DataFrame, *by: str) -> DataFrame:
    """Partials of more days and channels as one, by the columns named, to be merged further."""
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.hll_union_agg("articles").alias("articles"))


def figures(partials: DataFrame, *by: str) -> DataFrame:
    """Sums and rates by the columns named, and about how many articles there are (within some per cent)."""
    m = merged(partials, *by)
    return m.select(
        *by, *SUMS, F.hll_sketch_estimate("articles").alias("about_articles"), ratio(F.col("relevant"), F.col("results")).alias("relevance"), ratio(F.col("delivered") - F.col("failed"), F.col("delivered"), 100.0).alias("delivery_success"))


def run_rollup(partials: DataFrame, ok_unless: int = 7) -> DataFrame:
    """The totals of ``reports.run_rollup`` from partials: per run (a day) and channel, per run, and over all."""
    from sheaf.operators import reports

    return reports.run_rollup(partials.select(F.col("day").alias("run"), "chat_id", F.col("results").alias("articles"), F.col("delivered").alias("messages"), (F.col("delivered") % ok_unless != 0).alias("ok")))
