"""Health of feeds and providers from their logs: batch twins of the stateful streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def chunk_summaries(fetches: DataFrame, disable_at: int, chunk: int) -> DataFrame:
    """feed_id, chunk and what a stretch of ``chunk`` places of the log says whatever came before it.

    n rows, failures before the first success (``head``, with what was seen at each of the first
    ``disable_at`` of them) and after the last one (``tail``), whether it has a success, and what
    was seen where a run inside it reaches ``disable_at`` (``inner``). Windows are over a chunk."""
    rows = fetches.select("feed_id", "seq", "fetch_time", "success", F.floor(F.col("seq") / chunk).alias("chunk"))
    order = Window.partitionBy("feed_id", "chunk").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("ok_place", F.max(F.when(F.col("success"), F.col("place"))).over(upto))
    rows = rows.withColumn("fetched", F.max("fetch_time").over(upto)).withColumn("ok", F.max(F.when(F.col("success"), F.col("fetch_time"))).over(upto))
    seen = F.struct("seq", "fetched", "ok")
    head = F.col("ok_place").isNull()
    return rows.groupBy("feed_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(head).alias("head"), (F.count(F.lit(1)) - F.coalesce(F.max("ok_place"), F.lit(0))).alias("tail"), F.bool_or("success").alias("any_ok"),
        F.array_sort(F.collect_list(F.when(head & (F.col("place") <= disable_at), seen))).alias("head_seen"),
        F.min(F.when(F.col("place") - F.col("ok_place") >= disable_at, seen)).alias("inner"),
        F.max("fetch_time").alias("fetched"), F.max(F.when(F.col("success"), F.col("fetch_time"))).alias("ok"),
    )


def feed_states(fetches: DataFrame, disable_at: int = 10, chunk: int = 65_536) -> DataFrame:
    """feed_id, error_count, active, last_fetched_at, last_success_at after all events.

    A success resets the count, a failure adds one; at ``disable_at`` the feed is off, and later events
    are ignored, as it is no longer fetched. A segmented scan on two levels: the log is cut by seq
    (distinct within a feed) into chunks, each summed up for itself, so the events of one feed are
    spread over tasks; the failures that a chunk begins with follow from the counts of the chunks
    before it, one row each."""
    c = chunk_summaries(fetches, disable_at, chunk)
    order = Window.partitionBy("feed_id").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # where the run of failures begins that a chunk ends with; the last one before a chunk is the furthest
    c = c.withColumn("run_from", F.when(F.col("any_ok"), F.col("end") - F.col("tail")))
    c = c.withColumn("carry", F.col("end") - F.col("n") - F.coalesce(F.max("run_from").over(before), F.lit(0)))
    c = c.withColumn("fetched_before", F.max("fetched").over(before)).withColumn("ok_before", F.max("ok").over(before))
    need = F.greatest(F.lit(1), F.lit(disable_at) - F.col("carry")).cast("int")
    off = F.least(F.when(F.col("head") >= need, F.try_element_at("head_seen", need)), F.col("inner"))
    off = F.when(off.isNotNull(), F.struct(off["seq"].alias("seq"), F.greatest("fetched_before", off["fetched"]).alias("fetched"), F.greatest("ok_before", off["ok"]).alias("ok")))
    c = c.withColumn("off", off).withColumn("errors", F.when(F.col("any_ok"), F.col("tail")).otherwise(F.col("carry") + F.col("n")))
    g = c.groupBy("feed_id").agg(F.min("off").alias("off"), F.max_by("errors", "chunk").alias("errors"), F.max("fetched").alias("fetched"), F.max("ok").alias("ok"))
    on = F.col("off").isNull()
    return g.select(
        "feed_id", F.when(on, F.col("errors")).otherwise(F.lit(disable_at)).cast("long").alias("error_count"), on.alias("active"),
        F.when(on, F.col("fetched")).otherwise(F.col("off.fetched")).alias("last_fetched_at"), F.when(on, F.col("ok")).otherwise(F.col("off.ok")).alias("last_success_at"))


def feed_health(states: DataFrame, as_of: Column) -> DataFrame:
    """feed_id, label, score, hours since the last success, stale."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_success_at")) / 3600
    stale = F.coalesce(hours > 48, F.lit(False))
    label = F.when(~F.col("active"), "disabled").when(F.col("error_count") >= 10, "failing").when(F.col("error_count") >= 5, "unstable").when(stale, "stale").otherwise("healthy")
    return states.select("feed_id", label.alias("label"), F.round(F.greatest(F.lit(0.0), 1 - F.col("error_count") / 10), 6).alias("score"), F.round(hours, 6).alias("hours"), stale.alias("stale"))


def provider_states(calls: DataFrame, as_of: Column, healthy_below: int = 3, cool_down: int = 300) -> DataFrame:
    """provider, consecutive_errors, healthy, rate_limited, last_success, last_error after all calls.

    Errors in a row are counted by one aggregate, without sorting a provider's calls: those after its
    last success."""
    last = calls.groupBy("provider").agg(F.max(F.when(F.col("success"), F.col("seq"))).alias("last_ok"))
    j = calls.join(F.broadcast(last), "provider")  # a row per provider
    limited = F.max(F.when(F.col("rate_limited"), F.unix_timestamp("ts")))
    return j.groupBy("provider").agg(
        F.count_if(F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok"))).alias("consecutive_errors"), F.coalesce(limited + cool_down > F.unix_timestamp(as_of), F.lit(False)).alias("rate_limited"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_error"),
    ).withColumn("healthy", (F.col("consecutive_errors") < healthy_below) & ~F.col("rate_limited"))


def effective_priority(states: DataFrame, order: DataFrame) -> DataFrame:
    """provider, position, effective: healthy ones in order, then unhealthy ones that are not rate-limited;
    healthy ones without a configured position stand between. Rate-limited ones have no place."""
    j = states.join(order, "provider", "left")
    group = F.when(F.col("healthy") & F.col("position").isNotNull(), 0).when(F.col("healthy"), 1).when(~F.col("rate_limited"), 2)
    j = j.withColumn("_g", group)
    w = Window.orderBy(F.col("_g").asc_nulls_last(), F.col("position").asc_nulls_last(), "provider")  # a row per provider
    return j.select("provider", "position", F.when(F.col("_g").isNotNull(), F.row_number().over(w)).alias("effective"))


def _walk(at: np.ndarray, limit: int, entry: int) -> np.ndarray:
    """Places of the alerts that go out when the first is at ``entry``; ``at`` ascends."""
    following = np.searchsorted(at, at + limit)
    going, k = [], entry
    while k < len(at):
        going.append(k)
        k = following[k]
    return np.array(going, np.int64)


def _exits(at: np.ndarray, limit: int) -> np.ndarray:
    """For each event the last alert of the chunk if the event is an alert: pointers to the successor, doubled until they stay."""
    following = np.searchsorted(at, at + limit)
    to = np.where(following < len(at), following, np.arange(len(at)))
    while (to[to] != to).any():
        to = to[to]
    return at[to]


def alerts(events: DataFrame, limits: dict[str, int], chunk_limits: int = 256) -> DataFrame:
    """seq, severity of the alerts that go out: at most one per severity and limit, in seconds.

    Each second of a severity is reduced to its first event. Time is cut into chunks of
    ``chunk_limits`` limits. How a chunk is left depends on where it is entered, and it is entered
    within its first limit or at its first event behind it: each chunk tells for these events the
    last alert that would follow. One severity's chunks are then passed through in order, over
    these tables alone (a 64th of the time span, however many events there are), and each chunk
    walks from its true entry. Events without a severity in ``limits`` or without a time send nothing."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("severity"))
    e = events.groupBy("severity", F.unix_timestamp("ts").alias("at")).agg(F.min("seq").alias("seq")).withColumn("wait", limit.cast("long")).filter("wait IS NOT NULL AND at IS NOT NULL")
    e = e.withColumn("chunk", F.floor(F.col("at") / (F.col("wait") * chunk_limits)))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, wait, chunk = pdf["at"].to_numpy(), int(pdf["wait"].iloc[0]), int(pdf["chunk"].iloc[0])
        first = int(np.searchsorted(at, chunk * wait * chunk_limits + wait)) + 1  # entries, and one behind them
        return pd.DataFrame({"severity": np.full(1, pdf["severity"].iloc[0], object), "chunk": [chunk], "wait": [wait], "entries": [at[:first]], "exits": [_exits(at, wait)[:first]]})

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, entered = pdf.sort_values("chunk"), None, []
        for chunk, wait, entries, exits in zip(pdf["chunk"], pdf["wait"], pdf["entries"], pdf["exits"]):
            k = 0 if last is None else int(np.searchsorted(entries, last + wait))
            if k < len(entries):
                entered.append((pdf["severity"].iloc[0], chunk, int(entries[k])))
                last = exits[k]
        return pd.DataFrame(entered, columns=["severity", "chunk", "entry"]).astype({"severity": object})

    def walked(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entry.empty:
            return pd.DataFrame({"seq": np.zeros(0, np.int64), "severity": np.zeros(0, object)})
        rows = rows.sort_values("at")
        at = rows["at"].to_numpy()
        going = _walk(at, int(rows["wait"].iloc[0]), int(np.searchsorted(at, entry["entry"].iloc[0])))
        return pd.DataFrame({"seq": rows["seq"].to_numpy()[going], "severity": np.full(len(going), rows["severity"].iloc[0], object)})

    tables = e.groupBy("severity", "chunk").applyInPandas(table, "severity string, chunk long, wait long, entries array<long>, exits array<long>")
    entered = tables.groupBy("severity").applyInPandas(passed, "severity string, chunk long, entry long")
    return e.groupBy("severity", "chunk").cogroup(entered.groupBy("severity", "chunk")).applyInPandas(walked, "seq long, severity string")


def error_counts(events: DataFrame) -> DataFrame:
    """kind, value, n by category, component and severity."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("category", "component", "severity")]))
    return events.select(keys.alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def rate_usage(calls: DataFrame, per_minute: int = 30, per_day: int = 1000) -> DataFrame:
    """provider, span, start, n, exhausted for minutes and days."""
    one = lambda span, most: calls.groupBy("provider", F.window("ts", span).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("provider", F.lit(span).alias("span"), F.col("w.start").alias("start"), "n", (F.col("n") >= most).alias("exhausted"))
    return one("1 minute", per_minute).union(one("1 day", per_day))


def daily_counts(results: DataFrame) -> DataFrame:
    """day, chat_id, results, delivered."""
    g = results.groupBy(F.window("processed_at", "1 day").alias("w"), "chat_id").agg(F.count(F.lit(1)).alias("results"), F.count_if("delivered").alias("delivered"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "chat_id", "results", "delivered")
