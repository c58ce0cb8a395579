"""States of feeds and alerts over chunks of the log, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import health


@pytest.fixture(scope="module")
def log(spark):
    """Feed 0 has a third of all rows; some feeds fail for long."""
    rng = random.Random(3)
    rows = [(f, i, 1_700_000_000 + i * rng.choice([1, 3]), rng.random() < (0.02 if f % 7 == 3 else 0.5 if f else 0.35)) for i in range(3000) for f in [rng.choice([0] * 15 + list(range(1, 31)))]]
    return rows, spark.createDataFrame(rows, "feed_id long, seq long, t long, success boolean").selectExpr("feed_id", "seq", "timestamp_seconds(t) AS fetch_time", "success")


@pytest.mark.parametrize("disable_at, chunk", [(3, 7), (10, 100), (10, 65_536), (25, 7)])
def test_feed_states_by_chunks(log, disable_at, chunk):
    rows, df = log
    states = {}
    for feed, _, t, success in rows:
        errors, active, fetched, ok = states.get(feed, (0, True, None, None))
        if active:
            errors, ok = (0, max(t, ok or 0)) if success else (errors + 1, ok)
            states[feed] = (errors, errors < disable_at, max(t, fetched or 0), ok)
    got = health.feed_states(df, disable_at, chunk).select("feed_id", "error_count", "active", F.unix_timestamp("last_fetched_at"), F.unix_timestamp("last_success_at")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == states


def test_a_hot_feed_is_spread(log):
    """The rows of one feed are dealt by chunk, and only summaries by feed."""
    _, df = log
    c = health.chunk_summaries(df, 10, 100).filter("feed_id = 0")
    assert c.count() >= 30 and c.agg(F.max("n")).first()[0] <= 100


@pytest.mark.parametrize("steps", [[0, 1, 5, 30, 70], [0, 1, 1, 2, 4000], [1]])
@pytest.mark.parametrize("chunk_limits", [1, 2, 64])
def test_alerts_by_chunks(spark, steps, chunk_limits):
    rng, at, rows = random.Random(1), 1_700_000_000, []
    for i in range(1000):
        at += rng.choice(steps)
        rows.append((i, rng.choice(["critical", "high", "other", None]), at))
    df = spark.createDataFrame(rows + [(5000, "high", None)], "seq long, severity string, at long").selectExpr("seq", "severity", "timestamp_seconds(at) AS ts")
    limits, last, expected = {"critical": 60, "high": 300}, {}, []
    for seq, sev, t in rows:
        if sev in limits and (sev not in last or t - last[sev] >= limits[sev]):
            last[sev] = t
            expected.append(seq)
    assert sorted(r["seq"] for r in health.alerts(df, limits, chunk_limits).collect()) == expected


def test_empty_logs(log, spark):
    assert health.feed_states(log[1].limit(0)).count() == 0
    assert health.alerts(spark.createDataFrame([], "seq long, severity string, ts timestamp"), {"high": 300}).count() == 0
