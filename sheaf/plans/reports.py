"""Registered queries of reports, retention and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import daily, errors as er, reports as op, retention as rt
from sheaf.plans import matching as m, scoring
from sheaf.plans.views import now, view, with_views
from sheaf.sources.stage import shared_path

A = lambda s, d: view(s, d, "articles_raw")


def _ts(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def _feeds(s, d):
    f = view(s, d, "feeds").withColumn("owner", F.col("chat_id"))
    return f.withColumn("last_success_at", F.when(F.col("error_count") < 8, now() - F.make_interval(hours=F.col("id") % 90)))


def _channels(s, d):
    c = view(s, d, "channels")
    return c.withColumn("last_delivery_at", F.when(F.col("chat_id") != "2", now() - F.make_interval(hours=F.col("chat_id").cast("int") * 30)))


def a2(s, d):
    return op.feed_stats(_feeds(s, d)).withColumn("last_success_at", tx.stamp(F.col("last_success_at")))


def a5(s, d):
    t = view(s, d, "topics").withColumn("last_match_at", now() - F.make_interval(days=F.col("topic_ord") * 2))
    return op.topic_stats(t, view(s, d, "topic_keywords"), now())


def a9(s, d):
    t = view(s, d, "topics").withColumn("telegram_user_id", F.col("chat_id").cast("bigint") % 2 + F.col("topic_ord") % 2)
    return op.user_usage(t, view(s, d, "users"))


def a10(s, d):
    return op.delivery_stats(_channels(s, d), _feeds(s, d), A(s, d), now(), 2).withColumn("last_delivery_at", tx.stamp(F.col("last_delivery_at")))


def a11(s, d):
    return op.run_status(_channels(s, d), now()).withColumn("last_success", tx.stamp(F.col("last_success")))


def _log(s, d):
    """Results, of which every tenth could not be delivered."""
    return view(s, d, "results_log").withColumn("failed", F.col("delivered") & (F.col("seq") % 10 == 0))


def a12(s, d):
    feeds = view(s, d, "feeds").select("chat_id", F.col("url").alias("source_feed"))
    per = A(s, d).join(feeds, "source_feed")
    p = m.pairs(s, d)
    n = F.count(F.lit(1))
    time = F.col("ts").cast("timestamp")
    return op.funnel(view(s, d, "channels"), {
        "fetched": per.groupBy("chat_id").agg(n.alias("n")),
        "unique": per.groupBy("chat_id").agg(F.count_distinct("url").alias("n")),
        "passed": p.filter("matched").groupBy("chat_id").agg(F.count_distinct("id").alias("n")),
        "ready": scoring.accepted(s, d, p).groupBy("chat_id").agg(F.count_distinct("id").alias("n")),
        "fetches": view(s, d, "fetch_log").groupBy((F.col("feed_id") % 5).cast("string").alias("chat_id")).agg(F.count_if("success").alias("ok"), n.alias("all")),
        "calls": view(s, d, "call_log").groupBy("chat_id").agg(F.count_if("success").alias("ok"), n.alias("all"), (F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time))).alias("seconds")),
        "results": view(s, d, "results_log").groupBy("chat_id").agg(F.count_if(F.col("ai_relevance_score") >= 0.3).alias("relevant"), n.alias("all")),
        "deliveries": _log(s, d).groupBy("chat_id").agg(F.count_if("delivered").alias("sent"), F.count_if("failed").alias("failed")),
    })


def a13_daily(s, d):
    """A13 from daily partials, of which one day has been run again."""
    path, log = shared_path(s, "days"), _log(s, d)
    daily.write_days(daily.day_partials(log), path)
    daily.write_days(daily.day_partials(log.filter("date_format(processed_at, 'yyyy-MM-dd') = '2024-01-10'")), path)
    return daily.run_rollup(daily.read_days(s, path))


def a13(s, d):
    r = view(s, d, "results_log").groupBy(F.date_format("processed_at", "yyyy-MM-dd").alias("run"), "chat_id").agg(F.count(F.lit(1)).alias("articles"), F.count_if("delivered").alias("messages"))
    return op.run_rollup(r.withColumn("ok", F.col("messages") % 7 != 0))


def _errors(s, d):
    return er.classified(_ts(view(s, d, "error_events"), "ts", "resolved_at"))


def a16(s, d):
    return op.recent_errors(_errors(s, d), 40, "high").select("seq", "severity")


def a17(s, d):
    return op.retry_stats(_ts(view(s, d, "call_log"), "ts").withColumn("delay", (F.col("seq") % 60).cast("double")), now())


def a20(s, d):
    items = A(s, d).groupBy((F.col("seq") % 150).alias("feed_id")).agg(F.count(F.lit(1)).alias("n"))
    return op.ingest_summary(view(s, d, "fetch_log"), items)


def r1(s, d):
    left = rt.old_results(_ts(view(s, d, "processing_results"), "processed_at"), now(), 7)
    return rt.old_articles(A(s, d), left, now(), 2).select("id")


def r2(s, d):
    return rt.simple_retention(_ts(view(s, d, "processing_results"), "processed_at"), A(s, d), now(), 3)


def r3(s, d):
    gone = view(s, d, "channels").filter("NOT active OR chat_id = '2'")
    left = rt.cascade(gone, topics=view(s, d, "topics"), feeds=view(s, d, "feeds"), results=view(s, d, "processing_results"))
    parts = [df.groupBy("chat_id").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


def r4(s, d):
    return rt.resolved_errors(_ts(view(s, d, "error_events"), "ts", "resolved_at"), now(), 48).select("seq")


def v1(s, d):
    a = rt.row_rules(A(s, d).withColumn("content", F.repeat("content", 40)), 5000, 50)
    k = F.array_join(rt.keyword_list(F.array(F.col("title"), F.lower("title"), F.lit(" Deep-Learning! "), F.lit("??"))), "|")
    return a.select("id", "title", F.length("content").alias("n"), F.md5("content").alias("content_md5"), "content_hash", k.alias("keywords"))


def v2(s, d):
    return rt.violations(A(s, d), view(s, d, "topics"), view(s, d, "processing_results"), view(s, d, "channels").filter("active"))


def v3(s, d):
    i = A(s, d).select(F.col("id"), F.when(F.col("seq") % 19 != 0, F.col("title")).alias("title"), F.when(F.col("seq") % 23 == 0, None).when(F.col("seq") % 29 == 0, "ftp://x/y").otherwise(F.col("url")).alias("link"))
    good, bad = rt.split_rows(i)
    return good.select("id", F.lit("").alias("reason")).union(bad.select("id", "reason"))


QUERIES = {
    "A1_feed_counts": lambda s, d: op.feed_counts(A(s, d)),
    "A2_feed_stats": a2,
    "A3_feed_health_counts": lambda s, d: op.feed_health(view(s, d, "feeds"), A(s, d)),
    "A4_channel_feed_report": lambda s, d: op.channel_feeds(view(s, d, "feeds")),
    "A5_topic_stats": a5,
    "A6_channel_topic_report": lambda s, d: op.channel_topics(view(s, d, "topics"), view(s, d, "topic_keywords")),
    "A7_channel_stats": lambda s, d: op.channel_stats(view(s, d, "channels")),
    "A8_channel_status": lambda s, d: op.channel_status(view(s, d, "channels"), view(s, d, "topics"), view(s, d, "feeds"), A(s, d)),
    "A9_user_usage": a9, "A10_delivery_stats": a10, "A11_run_status": a11, "A12_funnel": a12, "A13_run_rollup": a13, "A13_run_rollup_daily": a13_daily,
    "A14_provider_breakdown": lambda s, d: op.provider_breakdown(view(s, d, "call_log")),
    "A15_error_stats": lambda s, d: op.error_stats(_errors(s, d), now(), 72),
    "A16_recent_errors": a16, "A17_retry_stats": a17,
    "A18_setup_audit": lambda s, d: op.setup_audit(view(s, d, "channels"), view(s, d, "feeds"), view(s, d, "topics"), view(s, d, "topic_keywords")),
    "A20_batch_ingest_summary": a20, "R1_retention": r1, "R2_retention_simple": r2, "R3_cascade_delete": r3, "R4_resolved_errors": r4, "V1_apply_row_rules": v1, "V2_violations": v2, "V3_filter_bad_rows": v3,
}

_pct = lambda a, b: f"round(CASE WHEN {b} > 0 THEN ({a}) / {b} * 100 ELSE 0 END, 6)::DOUBLE"
FEEDS = "fd AS (SELECT *, CASE WHEN error_count < 8 THEN TIMESTAMP '2024-01-31' - (id % 90) * INTERVAL '1' HOUR END AS last_success_at FROM feeds)"
CHANNELS = "ch AS (SELECT *, CASE WHEN chat_id <> '2' THEN TIMESTAMP '2024-01-31' - chat_id::INT * 30 * INTERVAL '1' HOUR END AS last_delivery_at FROM channels)"
NK = "nk AS (SELECT t.*, coalesce((SELECT count(*) FROM topic_keywords k WHERE k.name = t.name AND k.kind = 'include'), 0) AS nkw FROM topics t)"
URLP = f"CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches(lower(url), '{tx.SUSPICIOUS_URL}') THEN 'suspicious' END"
KW = r"substr(lower(trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}_\s\-]', '', 'g'), '\s+', ' ', 'g'))), 1, 100)"

SQL = {
    "A1_feed_counts": "SELECT source_feed, count(*) AS articles FROM articles_raw GROUP BY source_feed",
    "A2_feed_stats": f"""WITH {FEEDS} SELECT chat_id, count(*) AS total, count_if(active)::BIGINT AS active, count_if(error_count > 0)::BIGINT AS with_errors, round(avg(error_count), 6) AS average_errors,
        strftime(max(last_success_at), '%Y-%m-%d %H:%M:%S') AS last_success_at, count(DISTINCT chat_id0) AS channels FROM (SELECT *, chat_id AS chat_id0 FROM fd) GROUP BY GROUPING SETS ((chat_id), ())""",
    "A3_feed_health_counts": f"""SELECT f.chat_id, count_if(f.active)::BIGINT AS active, count_if(f.active AND error_count < 5)::BIGINT AS healthy, count_if(error_count > 0 AND f.active)::BIGINT AS with_errors,
        count_if(NOT f.active OR error_count >= 10)::BIGINT AS disabled, coalesce(sum(CASE WHEN f.active THEN n END), 0)::BIGINT AS articles, {_pct('count_if(f.active AND error_count < 5)', 'count_if(f.active)')} AS health
      FROM feeds f LEFT JOIN (SELECT source_feed, count(*) AS n FROM articles_raw GROUP BY 1) a ON a.source_feed = f.url GROUP BY GROUPING SETS ((f.chat_id), ())""",
    "A4_channel_feed_report": """SELECT chat_id, count_if(active AND error_count = 0)::BIGINT AS healthy, count_if(error_count > 0)::BIGINT AS with_errors, round(avg(error_count), 6) AS average_errors,
        array_to_string(list_sort(list(url || ' ' || error_count || ' ' || CASE WHEN active THEN 'active' ELSE 'off' END)), '; ') AS feeds FROM feeds GROUP BY chat_id""",
    "A5_topic_stats": f"""WITH {NK} SELECT count(*) AS total, count_if(active)::BIGINT AS active, round(avg(confidence_threshold), 6) AS average_threshold, round(avg(nkw), 6) AS average_keywords, max(nkw)::BIGINT AS most_keywords,
        count_if(topic_ord * 2 <= 7)::BIGINT AS matched_lately FROM nk""",
    "A6_channel_topic_report": f"WITH {NK} SELECT chat_id, count(*) AS topics, sum(nkw)::BIGINT AS keywords, round(avg(nkw), 6) AS average_keywords FROM nk GROUP BY chat_id",
    "A7_channel_stats": "SELECT count(*) AS total, count_if(active)::BIGINT AS active, count_if(NOT active)::BIGINT AS inactive, " + ", ".join(f"count_if(active AND chat_type = '{t}')::BIGINT AS active_{t}" for t in op.CHAT_TYPES) + " FROM channels",
    "A8_channel_status": """SELECT c.chat_id, (SELECT count(*) FROM topics t WHERE t.chat_id = c.chat_id) AS topics, (SELECT count(*) FROM feeds f WHERE f.chat_id = c.chat_id) AS feeds,
        (SELECT count(*) FROM articles_raw a WHERE a.source_feed IN (SELECT url FROM feeds f WHERE f.chat_id = c.chat_id)) AS articles FROM channels c""",
    "A9_user_usage": """WITH t AS (SELECT *, chat_id::BIGINT % 2 + topic_ord % 2 AS u FROM topics WHERE active), p AS (SELECT u, chat_id, count(*) AS n, array_to_string(list_sort(list(name)), ',') AS names FROM t GROUP BY u, chat_id),
      g AS (SELECT u, sum(n)::BIGINT AS topics, array_to_string(list_sort(list(chat_id || ':' || names)), ';') AS by_channel FROM p GROUP BY u)
      SELECT u AS telegram_user_id, coalesce(subscription_tier, 'free') AS tier, topics, by_channel, CASE WHEN coalesce(subscription_tier, 'free') = 'free' THEN 5 END AS topic_limit,
        coalesce(subscription_tier, 'free') = 'pro' OR topics < 5 AS can_add FROM g LEFT JOIN users ON telegram_user_id = u""",
    "A10_delivery_stats": f"""WITH {CHANNELS} SELECT chat_id, coalesce((SELECT sum(n) FROM (SELECT source_feed, count(*) AS n FROM articles_raw WHERE created_at >= TIMESTAMP '2024-01-29' GROUP BY 1) a JOIN feeds f ON f.url = a.source_feed AND f.active AND f.chat_id = ch.chat_id), 0)::BIGINT AS articles,
        strftime(last_delivery_at, '%Y-%m-%d %H:%M:%S') AS last_delivery_at FROM ch""",
    "A11_run_status": f"""WITH {CHANNELS} SELECT count_if(last_delivery_at >= TIMESTAMP '2024-01-24')::BIGINT AS deliveries, count_if(last_delivery_at::DATE = DATE '2024-01-31') > 0 AS today, strftime(max(last_delivery_at), '%Y-%m-%d %H:%M:%S') AS last_success,
        CASE WHEN count_if(last_delivery_at >= TIMESTAMP '2024-01-24') > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS success_rate, CASE WHEN count_if(last_delivery_at::DATE = DATE '2024-01-31') > 0 THEN 'healthy'
          WHEN count_if(last_delivery_at >= TIMESTAMP '2024-01-24') > 0 THEN 'degraded' ELSE 'unhealthy' END AS status FROM ch""",
    "A12_funnel": f"""WITH {scoring.ACCEPTED}, per AS (SELECT f.chat_id, count(*) AS fetched, count(DISTINCT a.url) AS uq FROM articles_raw a JOIN feeds f ON f.url = a.source_feed GROUP BY 1),
      pp AS (SELECT chat_id, count(DISTINCT id) AS passed FROM pairs WHERE matched GROUP BY 1), rd AS (SELECT chat_id, count(DISTINCT id) AS ready FROM accepted GROUP BY 1),
      fl AS (SELECT (feed_id % 5)::VARCHAR AS chat_id, count_if(success) AS ok, count(*) AS al FROM fetch_log GROUP BY 1),
      ca AS (SELECT chat_id, count_if(success) AS c_ok, count(*) AS c_all, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS secs FROM call_log GROUP BY 1),
      rs AS (SELECT chat_id, count_if(ai_relevance_score >= 0.3) AS rel_n, count(*) AS r_all, count_if(delivered) AS sent, count_if(delivered AND seq % 10 = 0) AS unsent FROM results_log GROUP BY 1),
      j AS (SELECT chat_id, coalesce(fetched, 0) AS fetched, coalesce(uq, 0) AS "unique", coalesce(passed, 0) AS passed, coalesce(ready, 0) AS ready, coalesce(ok, 0) AS ok, coalesce(al, 0) AS al,
          coalesce(c_ok, 0) AS c_ok, coalesce(c_all, 0) AS c_all, coalesce(secs, 0) AS secs, coalesce(rel_n, 0) AS rel_n, coalesce(r_all, 0) AS r_all, coalesce(sent, 0) AS sent, coalesce(unsent, 0) AS unsent
        FROM channels LEFT JOIN per USING (chat_id) LEFT JOIN pp USING (chat_id) LEFT JOIN rd USING (chat_id) LEFT JOIN fl USING (chat_id) LEFT JOIN ca USING (chat_id) LEFT JOIN rs USING (chat_id))
      SELECT chat_id, fetched, "unique", passed, ready, {_pct('ok', 'al')} AS feed_success, {_pct('fetched - "unique"', 'fetched')} AS deduplication, {_pct('"unique" - passed', '"unique"')} AS prefilter_reduction, {_pct('fetched - ready', 'fetched')} AS overall_reduction,
        round(CASE WHEN secs > 0 THEN fetched / secs ELSE 0 END, 6)::DOUBLE AS articles_per_second, {_pct('c_ok', 'c_all')} AS model_success, {_pct('rel_n', 'r_all')} AS relevance,
        round(CASE WHEN sent > 0 THEN (sent - unsent) / sent * 100 ELSE 100 END, 6)::DOUBLE AS delivery_success FROM j""",
    "A13_run_rollup": f"""WITH r AS (SELECT strftime(processed_at, '%Y-%m-%d') AS run, chat_id, count(*) AS articles, count_if(delivered) AS messages FROM results_log GROUP BY 1, 2)
      SELECT run, chat_id, sum(articles)::BIGINT AS articles, sum(messages)::BIGINT AS messages, round(CASE WHEN sum(messages) > 0 THEN sum(articles) / sum(messages) ELSE 0 END, 6)::DOUBLE AS articles_per_message,
        count_if(messages % 7 <> 0)::BIGINT AS ok, count_if(messages % 7 = 0)::BIGINT AS failed, {_pct('count_if(messages % 7 <> 0)', 'count(*)')} AS success_rate FROM r GROUP BY ROLLUP (run, chat_id)""",
    "A14_provider_breakdown": f"SELECT provider, count(*) AS requests, count_if(success)::BIGINT AS successes, count_if(NOT success)::BIGINT AS failures, {_pct('count_if(success)', 'count(*)')} AS success_rate FROM call_log GROUP BY provider",
    "A15_error_stats": f"""WITH {er.CLASSIFIED}, e AS (SELECT * FROM cls WHERE ts >= TIMESTAMP '2024-01-28')
      SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN severity IS NOT NULL THEN 'severity' WHEN component IS NOT NULL THEN 'component' ELSE 'all' END AS kind, coalesce(category, severity, component) AS value, count(*) AS errors,
        {_pct('count_if(recovery_successful)', 'count_if(recovery_attempted)')} AS recovery_rate FROM e GROUP BY GROUPING SETS ((category), (severity), (component), ())""",
    "A16_recent_errors": f"WITH {er.CLASSIFIED} SELECT seq, severity FROM (SELECT * FROM cls ORDER BY ts DESC, seq DESC LIMIT 80) WHERE severity = 'high' ORDER BY ts DESC, seq DESC LIMIT 40",
    "A17_retry_stats": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, {_pct('count_if(success)', 'count(*)')} AS success_rate, round(avg(seq % 60), 6) AS average_delay FROM call_log WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'))""",
    "A18_setup_audit": f"""WITH {NK}, f AS (SELECT chat_id, count(*) AS nf, count_if(error_count > 0) AS bad, count_if(error_count >= 10) AS dead FROM feeds GROUP BY 1),
      t AS (SELECT chat_id, count(*) AS nt, count_if(nkw < 2) AS few, count_if(confidence_threshold < 0.35) AS low FROM nk GROUP BY 1)
      SELECT chat_id, array_to_string(list_filter([CASE WHEN nf IS NULL THEN 'no feeds' END, CASE WHEN nt IS NULL THEN 'no topics' END, CASE WHEN few > 0 THEN few || ' topics with few keywords' END, CASE WHEN low > 0 THEN low || ' low thresholds' END,
        CASE WHEN bad > 0 THEN bad || ' feeds with errors' END, CASE WHEN dead > 0 THEN dead || ' feeds to disable' END], lambda x: x IS NOT NULL), '; ') AS issues, nf IS NOT NULL AND nt IS NOT NULL AS valid
      FROM channels LEFT JOIN f USING (chat_id) LEFT JOIN t USING (chat_id)""",
    "A20_batch_ingest_summary": """WITH g AS (SELECT feed_id, count_if(success) AS ok, count_if(NOT success) AS failed FROM fetch_log GROUP BY 1), i AS (SELECT seq % 150 AS feed_id, count(*) AS n FROM articles_raw GROUP BY 1)
      SELECT feed_id, sum(ok)::BIGINT AS ok, sum(failed)::BIGINT AS failed, sum(coalesce(n, 0))::BIGINT AS articles FROM g LEFT JOIN i USING (feed_id) GROUP BY ROLLUP (feed_id)""",
    "R1_retention": "SELECT id FROM articles_raw WHERE created_at >= TIMESTAMP '2024-01-29' OR id IN (SELECT article_id FROM processing_results WHERE processed_at >= TIMESTAMP '2024-01-24')",
    "R2_retention_simple": """SELECT 'results' AS "table", count_if(processed_at >= TIMESTAMP '2024-01-28')::BIGINT AS kept, count_if(processed_at < TIMESTAMP '2024-01-28')::BIGINT AS dropped FROM processing_results
      UNION ALL SELECT 'articles', count_if(created_at >= TIMESTAMP '2024-01-28')::BIGINT, count_if(created_at < TIMESTAMP '2024-01-28')::BIGINT FROM articles_raw""",
    "R3_cascade_delete": """WITH g AS (SELECT chat_id FROM channels WHERE NOT active OR chat_id = '2') SELECT chat_id, 'topics' AS "table", count(*) AS n FROM topics WHERE chat_id NOT IN (SELECT chat_id FROM g) GROUP BY chat_id
      UNION ALL SELECT chat_id, 'feeds', count(*) FROM feeds WHERE chat_id NOT IN (SELECT chat_id FROM g) GROUP BY chat_id UNION ALL SELECT chat_id, 'results', count(*) FROM processing_results WHERE chat_id NOT IN (SELECT chat_id FROM g) GROUP BY chat_id""",
    "R4_resolved_errors": "SELECT seq FROM error_events WHERE resolved_at IS NULL OR ts >= TIMESTAMP '2024-01-29'",
    "V1_apply_row_rules": f"""WITH c AS (SELECT id, title AS t0, substr(title, 1, 50) AS title, url, CASE WHEN length(repeat(content, 40)) > 5000 THEN substr(repeat(content, 40), 1, 5000) || '... [truncated]' ELSE repeat(content, 40) END AS content FROM articles_raw),
      k AS (SELECT *, list_filter(list_transform([title, lower(title), ' Deep-Learning! ', '??'], lambda x: {KW}), lambda x: x <> '') AS ks FROM c)
      SELECT id, title, length(content) AS n, md5(content) AS content_md5, sha256(title || '|' || url) AS content_hash, array_to_string(CASE WHEN len(ks) = 3 AND ks[1] = ks[2] THEN ks[2:] ELSE ks END, '|') AS keywords FROM k""",
    "V2_violations": f"""SELECT 'articles' AS "table", id AS key, unnest(list_filter([CASE WHEN trim(title) = '' THEN 'title_required' END, CASE WHEN {URLP} IS NOT NULL THEN 'url_' || {URLP} END, CASE WHEN length(content) > 50000 THEN 'content_long' END,
        CASE WHEN length(content) < 50 THEN 'content_short' END], lambda x: x IS NOT NULL)) AS code FROM articles_raw
      UNION ALL SELECT 'topics', chat_id || '|' || name, unnest(list_filter(['name_words', CASE WHEN NOT confidence_threshold BETWEEN 0 AND 1 THEN 'threshold_range' END], lambda x: x IS NOT NULL)) FROM topics
      UNION ALL SELECT 'articles', url, 'url_unique' FROM articles_raw GROUP BY url HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'results', article_id, 'article_missing' FROM processing_results WHERE article_id NOT IN (SELECT id FROM articles_raw)
      UNION ALL SELECT DISTINCT 'results', chat_id, 'channel_missing' FROM processing_results WHERE chat_id NOT IN (SELECT chat_id FROM channels WHERE active)""",
    "V3_filter_bad_rows": """SELECT id, CASE WHEN seq % 19 = 0 OR trim(title) = '' THEN 'no title' WHEN seq % 23 = 0 THEN 'no link' WHEN seq % 29 = 0 THEN 'invalid url: scheme' ELSE '' END AS reason FROM articles_raw""",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
SQL["A13_run_rollup_daily"] = SQL["A13_run_rollup"]
