"""Structured Streaming forms of the incremental operators. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.operators import dedup, errors, scoring, upserts
from sheaf.sources.buckets import BucketTable
from sheaf.streaming.keys import KeyDays, keys_of

HORIZON = "7 days"


def dedup_batches(keys: KeyDays, articles: BucketTable, as_of: Column, days: int = 7, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: exact duplicate verdicts of each micro-batch against itself and the
    keys of the last ``days``; what is unique and has a URL that ``articles`` (dealt by url) lacks is stored.

    A batch reads the keys of its horizon and the buckets it inserts into. One that is run again
    finds itself in the table's commits and does nothing, or, if it broke off before, writes the
    same keys again."""
    cutoff = as_of - F.expr(f"INTERVAL {days} DAYS")

    def run(batch: DataFrame, batch_id: int) -> None:
        if articles.has(batch_id):
            return
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        verdict = dedup.merged_verdicts(dedup.batch_duplicates(batch), dedup.history_duplicates(batch, keys.read(cutoff, batch_id), as_of, days))
        unique = batch.join(verdict.filter("NOT is_duplicate").select("seq"), "seq", "left_semi")
        new = unique.join(articles.touched(unique).select("url"), "url", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
        keys.write(keys_of(new), batch_id)
        upserts.insert_new(articles, new, batch_id)
        new.unpersist()
        batch.unpersist()
        if batch_id % compact_every == compact_every - 1:
            keys.compact(cutoff, batch_id)

    return run


def approximate_dedup(stream: DataFrame) -> DataFrame:
    """Two chained watermark deduplications, by hash and by URL. Approximate: a row whose URL was seen
    only on a hash duplicate of the same batch stays. Rows without a date take ``ingested_at``."""
    e = stream.withColumn("event_time", F.coalesce("published_at", "ingested_at")).withWatermark("event_time", HORIZON)
    return e.dropDuplicatesWithinWatermark(["content_hash"]).dropDuplicatesWithinWatermark(["url"])


class FeedState(StatefulProcessor):
    """Errors in a row of a feed, whether it is still fetched, and its last times."""

    def __init__(self, disable_at: int = 10):
        self.disable_at = disable_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feed", "errors int, active boolean, fetched timestamp, ok timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        errors, active, fetched, ok = self.state.get() if self.state.exists() else (0, True, None, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if not active:
                break
            fetched = r.fetch_time
            errors, ok = (0, r.fetch_time) if r.success else (errors + 1, ok)
            active = errors < self.disable_at
        self.state.update((errors, active, fetched, ok))
        yield pd.DataFrame({"feed_id": [key[0]], "error_count": [errors], "active": [active], "last_fetched_at": [fetched], "last_success_at": [ok]})

    def close(self) -> None:
        pass


def feed_states(stream: DataFrame) -> DataFrame:
    """Update-mode stream of feed states; needs the RocksDB state store."""
    return stream.groupBy("feed_id").transformWithStateInPandas(
        FeedState(), "feed_id long, error_count int, active boolean, last_fetched_at timestamp, last_success_at timestamp", "Update", "None")


class ProviderState(StatefulProcessor):
    """Errors in a row of a provider and its last times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("provider", "errors int, limited timestamp, ok timestamp, bad timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        errors, limited, ok, bad = self.state.get() if self.state.exists() else (0, None, None, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            errors, ok, bad = (0, r.ts, bad) if r.success else (errors + 1, ok, r.ts)
            limited = r.ts if r.rate_limited else limited
        self.state.update((errors, limited, ok, bad))
        yield pd.DataFrame({"provider": [key[0]], "consecutive_errors": [errors], "rate_limited_at": [limited], "last_success": [ok], "last_error": [bad]})

    def close(self) -> None:
        pass


def provider_states(stream: DataFrame) -> DataFrame:
    return stream.groupBy("provider").transformWithStateInPandas(
        ProviderState(), "provider string, consecutive_errors int, rate_limited_at timestamp, last_success timestamp, last_error timestamp", "Update", "None")


class AlertGate(StatefulProcessor):
    """Lets an alert pass when its severity had none for the limit."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        limit, last, out = self.limits.get(key[0]), self.last.get()[0] if self.last.exists() else None, []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            if limit is not None and (last is None or r.at - last >= limit):
                last = r.at
                out.append(r.seq)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"seq": out, "severity": [key[0]] * len(out)})

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, limits: dict[str, int]) -> DataFrame:
    rows = stream.select("seq", "severity", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("severity").transformWithStateInPandas(AlertGate(limits), "seq long, severity string", "Append", "None")


def error_counts(stream: DataFrame) -> DataFrame:
    """Running counts, for update mode."""
    from sheaf.operators.health import error_counts as batch

    return batch(errors.classified(stream))


def rate_usage(stream: DataFrame, span: str = "1 minute", most: int = 30) -> DataFrame:
    """Requests per provider and span, once the watermark has passed it."""
    g = stream.withWatermark("ts", "10 minutes").groupBy("provider", F.window("ts", span).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("provider", F.lit(span).alias("span"), F.col("w.start").alias("start"), "n", (F.col("n") >= most).alias("exhausted"))


def score_batches(topic_keywords: Callable[[SparkSession], DataFrame], topics: Callable[[SparkSession], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: scores arriving articles against the topics of the moment.

    Keywords and topics are read anew for each batch. No state is held, and a batch goes to a folder
    of its own below ``sink``, which it replaces when it is run again. Rows that the batch reads
    more than once are kept while it runs, on memory and disk; a lost executor's part is made again
    from the source."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, held = batch.sparkSession, []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return held[-1]

        scoring.score_articles(batch, topic_keywords(spark), topics(spark), keep).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        for df in held:
            df.unpersist()

    return run


def daily_counts(stream: DataFrame) -> DataFrame:
    g = stream.withWatermark("processed_at", "1 day").groupBy(F.window("processed_at", "1 day").alias("w"), "chat_id").agg(F.count(F.lit(1)).alias("results"), F.count_if("delivered").alias("delivered"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "chat_id", "results", "delivered")
