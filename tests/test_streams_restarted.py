"""Streams that stop after each file and go on from their checkpoint give what their batch twins give.

Each takes three files: one on time, one with late rows of both kinds (within the watermark and
behind it), and one of a far later time, which closes all windows before it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheaf.operators import health
from sheaf.plans.views import now
from sheaf.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp, provider string, success boolean, rate_limited boolean, chat_id string, delivered boolean, exception_type string, message string, component string"


def row(seq, minutes):
    types, messages = ["TimeoutError", "ValueError", "MemoryError"], ["request timed out", "fatal state", "odd value"]
    return (seq, START + dt.timedelta(minutes=minutes), "groq" if seq % 3 else "openai", seq % 5 not in (0, 1), seq % 5 == 0, str(seq % 2), seq % 4 == 0, types[seq % 3], messages[seq % 7 % 3], f"component{seq % 2}")


def restarted(spark, tmp_path, files, build, mode):
    """Rows of all batches with their number; the stream is started anew for each file."""
    out = f"{tmp_path}/out"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
        q = build(stream).writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.parquet(out)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def final(df, key):
    """Of an update-mode sink the last row of each key."""
    rest = [c for c in df.columns if c not in (*key, "batch_id")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*key, "r.*")


def test_rate_usage(spark, tmp_path):
    on_time = [row(i, i / 2) for i in range(120)]  # an hour; the watermark stands at 50 minutes
    late, dropped = [row(200, 55), row(201, 52)], [row(300, 5), row(301, 30)]
    more = [row(i, i / 2) for i in range(120, 160)]
    end = [row(999, 60 * 24 * 10)]
    got = restarted(spark, tmp_path, [on_time, more + late + dropped, end], lambda s: streams.rate_usage(s, "1 minute", 2), "append")
    expected = health.rate_usage(spark.createDataFrame(on_time + more + late, SCHEMA), 2, 10**6).filter("span = '1 minute'")
    assert rows_of(got.drop("batch_id")) == rows_of(expected)
    assert got.filter("batch_id < 2").count() > 0  # closed windows go out before the end


def test_daily_counts(spark, tmp_path):
    day = 60 * 24
    on_time = [row(i, i * day / 10) for i in range(40)]  # four days
    late, dropped = [row(200, 3.1 * day)], [row(300, 0.5 * day)]
    more = [row(i, i * day / 10) for i in range(40, 50)]
    end = [row(999, 60 * day)]
    got = restarted(spark, tmp_path, [on_time, more + late + dropped, end], lambda s: streams.daily_counts(s.withColumnRenamed("ts", "processed_at")), "append")
    expected = health.daily_counts(spark.createDataFrame(on_time + more + late, SCHEMA).withColumnRenamed("ts", "processed_at"))
    assert rows_of(got.drop("batch_id")) == rows_of(expected)


def test_error_counts(spark, tmp_path):
    files = [[row(i, i) for i in range(50)], [row(i, i - 40) for i in range(50, 90)], [row(90, 9_000)]]
    got = restarted(spark, tmp_path, files, streams.error_counts, "update")
    from sheaf.operators import errors

    expected = health.error_counts(errors.classified(spark.createDataFrame(sum(files, []), SCHEMA)))
    assert rows_of(final(got, ["kind", "value"])) == rows_of(expected)


@pytest.mark.parametrize("files", [[[row(i, i) for i in range(30)], [row(i, i) for i in range(30, 62)], [row(65, 70), row(70, 80), row(66, 71)]]])
def test_provider_states(spark, tmp_path, files):
    got = final(restarted(spark, tmp_path, files, streams.provider_states, "update"), ["provider"])
    columns = ["provider", "consecutive_errors", "last_success", "last_error"]
    expected = health.provider_states(spark.createDataFrame(sum(files, []), SCHEMA), now()).select(*columns)
    assert rows_of(got.select(*columns).withColumn("consecutive_errors", F.col("consecutive_errors").cast("long"))) == rows_of(expected)
