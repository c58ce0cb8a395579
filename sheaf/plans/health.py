"""Registered queries of health, errors and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.functions.words import PROVIDER_ORDER
from sheaf.operators import dedup, errors as er, health as op, scoring
from sheaf.plans.matching import topic_feeds
from sheaf.plans.views import now, view, with_views
from sheaf.sources.stage import staged

#: Seconds between two alerts of a severity (fixed values).
ALERT_LIMITS = {"critical": 60, "high": 300, "medium": 900, "low": 3600}


def _fetches(s, d):
    return view(s, d, "fetch_log").withColumn("fetch_time", F.col("fetch_time").cast("timestamp"))


def _calls(s, d):
    return view(s, d, "call_log").withColumn("ts", F.col("ts").cast("timestamp"))


def _errors(s, d):
    return er.classified(view(s, d, "error_events").withColumn("ts", F.col("ts").cast("timestamp")))


def t1(s, d):
    """All rows as one batch of the exact stream, against the history."""
    a, h = view(s, d, "articles_raw"), view(s, d, "history")
    v = dedup.merged_verdicts(dedup.batch_duplicates(a), dedup.history_duplicates(a, h, now()))
    return a.join(v.filter("NOT is_duplicate").select("seq"), "seq", "left_semi").join(h.select("url"), "url", "left_anti").select("seq", "url")


def t2(s, d):
    return op.feed_states(_fetches(s, d)).withColumn("last_fetched_at", tx.stamp(F.col("last_fetched_at"))).withColumn("last_success_at", tx.stamp(F.col("last_success_at")))


def t3(s, d):
    return op.feed_health(op.feed_states(_fetches(s, d)), now())


def t4(s, d):
    p = op.provider_states(_calls(s, d).filter("seq % 11 <> 0 OR NOT success"), now())
    return p.withColumn("last_success", tx.stamp(F.col("last_success"))).withColumn("last_error", tx.stamp(F.col("last_error")))


def t5(s, d):
    order = s.createDataFrame([(p, i) for i, p in enumerate(PROVIDER_ORDER[:3])], "provider string, position int")
    return op.effective_priority(op.provider_states(_calls(s, d).filter("provider <> 'groq' OR NOT success"), now()), order)


def t11(s, d):
    return op.rate_usage(_calls(s, d), 2, 80).withColumn("start", tx.stamp(F.col("start")))


def t12(s, d):
    return scoring.score_articles(view(s, d, "articles_raw"), view(s, d, "topic_keywords"), topic_feeds(s, d), lambda df: staged(df, "scores", plain="clean_text" not in df.columns))


def t13(s, d):
    return op.daily_counts(view(s, d, "results_log").withColumn("processed_at", F.col("processed_at").cast("timestamp")))


QUERIES = {
    "T1_stream_dedup": t1, "T2_feed_error_state": t2, "T3_feed_health": t3, "T4_provider_health": t4, "T5_effective_priority": t5,
    "T7_error_classify": lambda s, d: _errors(s, d).select("seq", "category", "severity"), "T8_alert_suppression": lambda s, d: op.alerts(_errors(s, d), ALERT_LIMITS),
    "T9_error_counts": lambda s, d: op.error_counts(_errors(s, d)), "T11_rate_usage": t11, "T12_stream_score": t12, "T13_daily_windows": t13,
}

STATES = """r AS (SELECT *, sum(success::INT) OVER (PARTITION BY feed_id ORDER BY seq) AS run FROM fetch_log),
e AS (SELECT *, sum((NOT success)::INT) OVER (PARTITION BY feed_id, run ORDER BY seq) AS errors FROM r),
o AS (SELECT feed_id, min(seq) AS off_at FROM e WHERE errors >= 10 GROUP BY feed_id),
k AS (SELECT e.*, o.off_at FROM e LEFT JOIN o USING (feed_id) WHERE off_at IS NULL OR seq <= off_at),
st AS (SELECT feed_id, arg_max(errors, seq)::BIGINT AS error_count, max(off_at) IS NULL AS active, max(fetch_time) AS lf, max(CASE WHEN success THEN fetch_time END) AS ls FROM k GROUP BY feed_id)"""


def _providers(where):
    return f"""cl AS (SELECT * FROM call_log WHERE {where}), lo AS (SELECT provider, max(CASE WHEN success THEN seq END) AS last_ok FROM cl GROUP BY provider),
ps AS (SELECT provider, count_if(last_ok IS NULL OR seq > last_ok)::BIGINT AS consecutive_errors, coalesce(max(CASE WHEN rate_limited THEN floor(epoch(ts)) END) + 300 > epoch(TIMESTAMP '2024-01-31'), false) AS rate_limited,
  max(CASE WHEN success THEN ts END) AS ok, max(CASE WHEN NOT success THEN ts END) AS bad FROM cl JOIN lo USING (provider) GROUP BY provider),
p AS (SELECT *, consecutive_errors < 3 AND NOT rate_limited AS healthy FROM ps)"""


from sheaf.plans.dedup import MERGED  # noqa: E402
from sheaf.plans.scoring import ROUTED_ALONE  # noqa: E402

SQL = {
    "T1_stream_dedup": f"WITH {MERGED} SELECT seq, url FROM v WHERE NOT is_duplicate AND url NOT IN (SELECT url FROM history)",
    "T2_feed_error_state": f"WITH {STATES} SELECT feed_id, error_count, active, strftime(lf, '%Y-%m-%d %H:%M:%S') AS last_fetched_at, strftime(ls, '%Y-%m-%d %H:%M:%S') AS last_success_at FROM st",
    "T3_feed_health": f"""WITH {STATES}, h AS (SELECT *, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ls))) / 3600 AS hours FROM st)
      SELECT feed_id, CASE WHEN NOT active THEN 'disabled' WHEN error_count >= 10 THEN 'failing' WHEN error_count >= 5 THEN 'unstable' WHEN hours > 48 THEN 'stale' ELSE 'healthy' END AS label,
        round(greatest(0, 1 - error_count / 10), 6)::DOUBLE AS score, round(hours, 6) AS hours, coalesce(hours > 48, false) AS stale FROM h""",
    "T4_provider_health": f"WITH {_providers('seq % 11 <> 0 OR NOT success')} SELECT provider, consecutive_errors, rate_limited, strftime(ok, '%Y-%m-%d %H:%M:%S') AS last_success, strftime(bad, '%Y-%m-%d %H:%M:%S') AS last_error, healthy FROM p",
    "T5_effective_priority": f"""WITH {_providers("provider <> 'groq' OR NOT success")}, j AS (SELECT *, CASE provider WHEN 'groq' THEN 0 WHEN 'deepseek' THEN 1 WHEN 'gemini' THEN 2 END AS position FROM p),
      g AS (SELECT *, CASE WHEN healthy AND position IS NOT NULL THEN 0 WHEN healthy THEN 1 WHEN NOT rate_limited THEN 2 END AS g FROM j)
      SELECT provider, position::INT AS position, CASE WHEN g IS NOT NULL THEN row_number() OVER (ORDER BY g NULLS LAST, position NULLS LAST, provider) END::INT AS effective FROM g""",
    "T7_error_classify": f"WITH {er.CLASSIFIED} SELECT seq, category, severity FROM cls",
    "T8_alert_suppression": f"""WITH RECURSIVE {er.CLASSIFIED}, lm AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in ALERT_LIMITS.items())}) v(severity, wait)),
      ev AS MATERIALIZED (SELECT severity, floor(epoch(ts))::BIGINT AS sec, min(seq) AS seq, any_value(wait) AS wait FROM cls JOIN lm USING (severity) GROUP BY ALL),
      al AS (SELECT severity, min(sec) AS sec FROM ev GROUP BY severity UNION ALL SELECT ev.severity, min(ev.sec) FROM al JOIN ev ON ev.severity = al.severity AND ev.sec >= al.sec + ev.wait GROUP BY ev.severity)
      SELECT seq, severity FROM al JOIN ev USING (severity, sec)""",
    "T9_error_counts": f"WITH {er.CLASSIFIED} SELECT 'category' AS kind, category AS value, count(*) AS n FROM cls GROUP BY category UNION ALL SELECT 'component', component, count(*) FROM cls GROUP BY component UNION ALL SELECT 'severity', severity, count(*) FROM cls GROUP BY severity",
    "T11_rate_usage": """SELECT provider, '1 minute' AS span, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) >= 2 AS exhausted FROM call_log GROUP BY provider, date_trunc('minute', ts)
      UNION ALL SELECT provider, '1 day', strftime(date_trunc('day', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S'), count(*), count(*) >= 80 FROM call_log GROUP BY provider, date_trunc('day', ts)""",
    "T12_stream_score": f"WITH {ROUTED_ALONE} SELECT id, chat_id, name, relevance, confidence, routing, action FROM routed",
    "T13_daily_windows": "SELECT strftime(processed_at, '%Y-%m-%d') AS day, chat_id, count(*) AS results, count_if(delivered)::BIGINT AS delivered FROM results_log GROUP BY 1, 2",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
