"""Streams give what their batch twins give."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from sheaf.operators import errors, health, scoring
from sheaf.plans.health import ALERT_LIMITS
from sheaf.plans.views import now, view
from sheaf.sources.buckets import BucketTable
from sheaf.streaming import streams
from sheaf.streaming.keys import KeyDays, keys_of


def run(spark, tmp_path, df, build, mode="append", parts=2):
    """Feeds ``df`` in order of seq as some files and returns all rows of the sink, last batch last."""
    source, out = f"{tmp_path}/in", f"out_{uuid.uuid4().hex}"
    for i in range(parts):
        df.filter(F.pmod(F.floor(F.col("seq") / F.lit(200)), F.lit(1000)) * 0 + F.floor(F.col("seq") * parts / (df.agg(F.max("seq")).first()[0] + 1)) == i).coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    q = build(stream).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(out)


def test_alerts(spark, data, tmp_path):
    e = errors.classified(view(spark, data, "error_events").withColumn("ts", F.col("ts").cast("timestamp"))).select("seq", "severity", "ts")
    e = e.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 20))
    got = {r["seq"] for r in run(spark, tmp_path, e, lambda s: streams.alerts(s, ALERT_LIMITS)).collect()}
    assert got == {r["seq"] for r in health.alerts(e, ALERT_LIMITS).collect()}


def test_feed_states(spark, data, tmp_path):
    f = view(spark, data, "fetch_log").withColumn("fetch_time", F.col("fetch_time").cast("timestamp")).withColumn("feed_id", F.col("feed_id") % 20)
    rows = run(spark, tmp_path, f, streams.feed_states, "update").collect()
    last = {r["feed_id"]: (r["error_count"], r["active"]) for r in rows}
    assert last == {r["feed_id"]: (r["error_count"], r["active"]) for r in health.feed_states(f).collect()}


def start(spark, tmp_path, schema, step):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_exact_dedup(spark, data, tmp_path):
    """A stream of four batches that breaks off in the third gives the rows of the batch query."""
    a, h = view(spark, data, "articles_raw"), view(spark, data, "history")
    columns = ["id", "seq", "title", "url", "content", "published_at", "created_at"]
    stored = BucketTable(spark, f"{tmp_path}/articles", ["url"]).create(h.select(*columns), 8)
    keys = KeyDays(spark, f"{tmp_path}/keys")
    keys.write(keys_of(h), -1)
    step, fail = streams.dedup_batches(keys, stored, now(), compact_every=2), {2}

    def breaking(batch, batch_id):
        if batch_id in fail:
            fail.discard(batch_id)
            keys.write(keys_of(batch.limit(1)), batch_id + 1000)  # of a batch that has not been: is not read
            raise OSError("lost")
        step(batch, batch_id)

    for i in range(4):
        a.select(*columns).filter(f"seq DIV 60 = {i}" if i < 3 else "seq >= 180").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path, a.select(*columns).schema, breaking)
    start(spark, tmp_path, a.select(*columns).schema, breaking)
    expected = sorted(r["seq"] for r in entry.queries()["T1_stream_dedup"](spark, data).collect())
    before = {r["seq"] for r in h.collect()}
    got = stored.read().select("seq", "url").collect()
    assert sorted(r["seq"] for r in got if r["seq"] not in before) == sorted(s for s in expected if s not in before)
    assert len(got) == h.count() + len(expected)
    step(a.select(*columns).filter("seq >= 180"), 3)  # a batch that runs again changes nothing
    assert stored.read().count() == len(got)


def test_a_batch_reads_the_days_of_its_horizon(spark, tmp_path):
    """Ten times the history, the same bytes; compaction keeps the keys and drops old days."""
    keys, cutoff = KeyDays(spark, f"{tmp_path}/keys"), now() - F.expr("INTERVAL 7 DAYS")
    assert keys.read(cutoff).count() == 0
    rows = lambda days: spark.range(days * 20).selectExpr("concat('t', id) AS title", "concat('u', id) AS url", f"timestamp'2024-01-31' - make_interval(0, 0, 0, CAST(id % {days} AS INT)) AS created_at", "CAST(NULL AS TIMESTAMP) AS published_at")
    keys.write(keys_of(rows(8)), 0)
    keys.write(keys_of(rows(8).withColumn("url", F.concat("url", F.lit("-b")))), 1)
    read = lambda: {r[0] for r in keys.read(cutoff).select(F.input_file_name()).distinct().collect()}
    files, found = read(), keys.read(cutoff).count()
    keys.write(keys_of(rows(80).filter("created_at < timestamp'2024-01-20'")), 2)
    assert read() == files and keys.read(cutoff).count() == found == 320
    assert keys.read(cutoff, before=1).count() == 160
    plan = keys.read(cutoff)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    known = sorted(map(tuple, keys.read(cutoff).select("url", "content_hash", "created_at").collect()))
    keys.compact(cutoff, 3)
    assert len([n for n in keys.files.names(f"{tmp_path}/keys") if n.startswith("day=")]) == len(read()) == 8
    assert sorted(map(tuple, keys.read(cutoff).select("url", "content_hash", "created_at").collect())) == known
    keys.compact(cutoff, 3)
    assert keys.read(cutoff).count() == found


def test_scores_of_arriving_articles(spark, data, tmp_path):
    """Two starts of one stream, 2,100 keywords, and topics that change between the starts."""
    articles, source, sink = view(spark, data, "articles_raw"), f"{tmp_path}/in", f"{tmp_path}/out"
    words = [r[0] for r in articles.select(F.explode(F.split(F.lower("content"), "[^a-zà-ÿ]+")).alias("w")).filter("length(w) > 3").distinct().orderBy("w").limit(2094).collect()]
    more = spark.createDataFrame([(f"t{i % 90}", i, w, "include") for i, w in enumerate(words)], "name string, kw_ord int, keyword string, kind string")
    few = view(spark, data, "topic_keywords").filter("kind = 'include'").limit(6)
    topics = more.union(few).select("name").distinct().crossJoin(view(spark, data, "feeds").select("chat_id", F.col("url").alias("source_feed")).filter("chat_id < '2'")).withColumn("topic_ord", F.hash("name"))
    now_topics = {"k": few}
    articles.filter("seq % 2 = 0").coalesce(1).write.parquet(f"{source}/0")
    step = streams.score_batches(lambda s: now_topics["k"], lambda s: topics, sink)
    start(spark, tmp_path, articles.schema, step)
    now_topics["k"] = few.union(more)
    articles.filter("seq % 2 = 1").coalesce(1).write.parquet(f"{source}/1")
    start(spark, tmp_path, articles.schema, step)
    expected = [scoring.score_articles(articles.filter(f"seq % 2 = {i}"), k, topics) for i, k in ((0, few), (1, few.union(more)))]
    kept = spark.read.parquet(sink)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(kept.drop("batch_id")) == rows(expected[0].union(expected[1])) and kept.select("batch_id").distinct().count() == 2
    assert kept.filter("batch_id = 1").select("name").distinct().count() > 50
