"""Views that give the driver's tables the shapes of a curation system; the same SQL runs in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The fixed clock of all registered queries.
AS_OF = "2024-01-31 00:00:00"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "articles_raw": """
SELECT CAST(doc_id AS STRING) AS id, doc_id AS seq,
       substr(split_part(text, chr(10), 1), 1, 120) AS title,
       'https://' || source || '.example.com/a/'
         || CAST(CASE WHEN doc_id % 11 = 0 AND doc_id >= 20 THEN doc_id - 20 ELSE doc_id END AS STRING)
         || CASE WHEN doc_id % 5 = 0 THEN '?utm_source=feed' WHEN doc_id % 7 = 0 THEN '?page=2&ref=x' ELSE '' END
         || CASE WHEN doc_id % 13 = 0 THEN '#top' ELSE '' END AS url,
       text AS content,
       'https://' || source || '.example.com/feed.xml' AS source_feed,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 400) * INTERVAL '1' HOUR END AS published_at,
       TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 96) * INTERVAL '1' HOUR AS created_at
FROM documents""",
    "channels": """
SELECT DISTINCT CAST(user_id % 5 AS STRING) AS chat_id, 'Channel ' || CAST(user_id % 5 AS STRING) AS chat_title,
       CASE user_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'channel' WHEN 2 THEN 'group' ELSE 'supergroup' END AS chat_type,
       user_id % 5 <> 4 AS active
FROM events""",
    "feeds": """
SELECT s.k * 5 + c.k AS id, CAST(c.k AS STRING) AS chat_id,
       'https://src' || CAST(s.k AS STRING) || '.example.com/feed.xml' AS url,
       CAST((s.k * 7 + c.k) % 13 AS INT) AS error_count, (s.k * 7 + c.k) % 13 < 10 AS active
FROM (SELECT DISTINCT doc_id % 20 AS k FROM documents) s
CROSS JOIN (SELECT DISTINCT user_id % 5 AS k FROM events) c
WHERE (s.k + c.k) % 3 <> 0""",
    "topics": """
SELECT c.chat_id, t.name, t.topic_ord, CAST(0.3 AS DOUBLE) + CAST(c.chat_id AS DOUBLE) / 10 AS confidence_threshold,
       NOT (c.chat_id = '2' AND t.name = 'view') AS active
FROM channels c
CROSS JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 4), ('error', 5)) AS t(name, topic_ord)""",
    "topic_keywords": """
SELECT * FROM (VALUES
  ('click', 1, 'thing', 'include'), ('click', 2, 'the anea', 'include'), ('click', 3, 'attion to', 'include'),
  ('click', 1, 'license', 'exclude'),
  ('view', 1, 'ering', 'include'), ('view', 2, 'thanedble', 'include'), ('view', 3, 'of the', 'include'),
  ('purchase', 1, 'nicht', 'include'), ('purchase', 2, 'de la', 'include'), ('purchase', 3, 'ertion', 'include'),
  ('signup', 1, 'eriner thanea', 'include'), ('signup', 2, 'attion', 'include'), ('signup', 3, 'is', 'include'),
  ('error', 1, 'oning', 'include'), ('error', 2, 'retion heble', 'include'), ('error', 3, 'zzz none', 'include'),
  ('error', 1, 'nicht', 'exclude')
) AS k(name, kw_ord, keyword, kind)""",
    "results_log": """
SELECT event_id AS seq, CAST(event_id % 200 AS STRING) AS article_id, CAST(user_id % 5 AS STRING) AS chat_id, event_type AS topic_name,
       least(value / 500, CAST(1 AS DOUBLE)) AS ai_relevance_score, CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS confidence_score,
       ts AS processed_at, event_id % 3 = 0 AS delivered
FROM events""",
    "processing_results": """
SELECT seq, article_id, chat_id, topic_name, ai_relevance_score, confidence_score, processed_at, delivered FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, chat_id, topic_name ORDER BY seq DESC) AS rn FROM results_log) x
WHERE rn = 1""",
    "fetch_log": """
SELECT event_id AS seq, user_id AS feed_id, ts AS fetch_time,
       NOT (event_type = 'error' OR user_id % 10 = 3 AND event_type IN ('click', 'view', 'purchase')) AS success
FROM events""",
    "call_log": """
SELECT event_id AS seq, ts, CASE event_id % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'deepseek' WHEN 2 THEN 'gemini' ELSE 'openai' END AS provider,
       event_type <> 'error' AS success, event_type = 'error' AND event_id % 2 = 0 AS rate_limited,
       least(value / 500, CAST(1 AS DOUBLE)) AS relevance, CAST((event_id * 53) % 101 AS DOUBLE) / 100 AS confidence,
       CAST(event_id % 200 AS STRING) AS article_id, event_type AS topic_name, CAST(user_id % 5 AS STRING) AS chat_id
FROM events""",
    "error_events": """
SELECT event_id AS seq, ts,
       CASE event_id % 6 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'OperationalError' WHEN 2 THEN 'ValueError'
            WHEN 3 THEN 'MemoryError' WHEN 4 THEN 'KeyError' ELSE 'CustomError' END AS exception_type,
       CASE event_id % 7 WHEN 0 THEN 'request timed out' WHEN 1 THEN 'connection lost' WHEN 2 THEN 'bad rss entry'
            WHEN 3 THEN 'invalid api key' WHEN 4 THEN 'missing setting' WHEN 5 THEN 'fatal state' ELSE 'odd value' END AS message,
       'component' || CAST(user_id % 4 AS STRING) AS component,
       event_id % 2 = 0 AS recovery_attempted, event_id % 4 = 0 AS recovery_successful,
       CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' HOUR END AS resolved_at
FROM events""",
    "users": """
SELECT c_custkey AS telegram_user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pro' ELSE 'free' END AS subscription_tier FROM customer""",
    "incoming": "SELECT * FROM articles_raw WHERE seq % 2 = 1",
    "history": """
SELECT CASE WHEN seq % 10 = 0 THEN CAST(seq + 1 AS STRING) ELSE id END AS id, title,
       CASE WHEN seq % 6 = 0 THEN 'https://src' || CAST((seq + 1) % 20 AS STRING) || '.example.com/a/' || CAST(seq + 1 AS STRING) ELSE url END AS url,
       content, source_feed, published_at, created_at - (seq % 3) * INTERVAL '5' DAY AS created_at, seq
FROM articles_raw WHERE seq % 4 = 0 OR seq % 9 = 1""",
}


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def needs(sql: str) -> list[str]:
    """Views that a statement reads, those they read first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [n for n in [*needs(VIEWS[name]), name] if n not in found]
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or a view over its tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for n in needs(VIEWS[name]):
        view(spark, sf_dir, n).createOrReplaceTempView(n)
    for n in TABLES:
        if re.search(rf"\b{n}\b", VIEWS[name]):
            view(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it reads in front."""
    names = needs(sql)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    sql = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{ctes},\n{sql[len(start):]}" if ctes else sql
    return f"WITH {ctes}\n{sql}" if ctes else sql
