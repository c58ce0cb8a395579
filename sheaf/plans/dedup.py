"""Registered queries of duplicates and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import dedup as op, upserts
from sheaf.plans.views import now, view, with_views
from sheaf.sources.buckets import BucketTable
from sheaf.sources.stage import shared_path

A = lambda s, d: view(s, d, "articles_raw")


def _shown(v):
    return v.withColumn("issues", F.array_join("issues", "; "))


def _verdicts(s, d):
    a = A(s, d)
    return op.merged_verdicts(op.batch_duplicates(a), op.history_duplicates(a, view(s, d, "history"), now()))


def d3(s, d):
    return _shown(op.batch_duplicates(A(s, d))).drop("url")


def d4(s, d):
    return _shown(op.history_duplicates(A(s, d), view(s, d, "history"), now()))


def d5(s, d):
    return _shown(_verdicts(s, d).filter("NOT is_duplicate"))


def d6(s, d):
    return op.dedup_stats(_verdicts(s, d))


def d7(s, d):
    v, a = _verdicts(s, d), A(s, d)
    summary = op.dedup_summary(a, v, now())
    return op.issue_histogram(v).crossJoin(F.broadcast(summary))  # the summary is one row


def d8(s, d):
    return op.unknown_hashes(view(s, d, "incoming").select("id", "title", "url"), view(s, d, "history")).select("id", "content_hash")


def d9(s, d):
    cols = ["id", "title", "url", "seq"]
    return op.insert_new(view(s, d, "history").select(*cols), view(s, d, "incoming").select(*cols))


def d10(s, d):
    cols = ["id", "title", "url", "seq"]
    return op.replace_batch(view(s, d, "history").select(*cols), view(s, d, "incoming").select(*cols))


def _scored(s, d):
    stored = view(s, d, "history").groupBy("url").agg(F.min(F.struct("seq", "id", "title")).alias("r")).select("r.id", "r.title", "url")
    stored = stored.withColumn("ai_relevance_score", F.lit(0.1)).withColumn("ai_confidence", F.lit(None).cast("double"))
    scored = view(s, d, "incoming").groupBy("url").agg(F.max(F.struct("seq", "id", "title")).alias("r")).select("r.id", "r.title", "url", (F.col("r.seq") % 100 / 100).alias("ai_relevance_score"), F.lit(0.5).alias("ai_confidence"))
    return stored, scored


def d11(s, d):
    return op.merge_scores(*_scored(s, d))


def _results(s, d):
    log = view(s, d, "results_log").withColumn("processed_at", tx.stamp(F.col("processed_at")))
    stored = op.latest(log.filter("seq % 5 <> 0"), op.RESULT_KEY)
    return stored, op.latest(log.filter("seq % 5 = 0"), op.RESULT_KEY)


def d12(s, d):
    return op.merge_results(*_results(s, d))


def d13(s, d):
    m = A(s, d).select("seq", "id", "source_feed", "published_at", tx.body_hash(F.col("content"), F.lit(None).cast("string")).alias("body_hash"))
    feeds = view(s, d, "feeds").select("chat_id", F.col("url").alias("source_feed"))
    topics = view(s, d, "topics").filter("active").select("chat_id", "topic_ord")
    e = m.join(feeds, "source_feed").join(topics, "chat_id")
    e = e.withColumn("age", -F.coalesce(F.unix_timestamp("published_at"), F.lit(0)))
    out = op.repeat_bonus(e, [F.col(c) for c in ("chat_id", "topic_ord", "age", "id")])
    return out.select("id", "chat_id", "topic_ord", "bonus")


def _stored(s, label, key, rows, buckets=32):
    return BucketTable(s, shared_path(s, label), key).create(rows, buckets)


def d9_stored(s, d):
    """D9 into a table of buckets by URL."""
    cols = ["id", "title", "url", "seq"]
    t = _stored(s, "articles", ["url"], view(s, d, "history").select(*cols))
    upserts.insert_new(t, view(s, d, "incoming").select(*cols))
    return t.read()


def d10_stored(s, d):
    """D10 into a table of buckets by URL, with an index by id."""
    cols = ["id", "title", "url", "seq"]
    h = view(s, d, "history").select(*cols)
    t, index = _stored(s, "articles", ["url"], h), upserts.id_index(s, shared_path(s, "ids"), h, 32)
    upserts.replace_batch(t, index, view(s, d, "incoming").select(*cols))
    return t.read()


def d11_stored(s, d):
    stored, scored = _scored(s, d)
    t = _stored(s, "articles", ["url"], stored)
    upserts.merge_scores(t, scored)
    return t.read()


def d12_stored(s, d):
    stored, new = _results(s, d)
    t = _stored(s, "results", op.RESULT_KEY, stored)
    upserts.merge_results(t, new)
    return t.read()


QUERIES = {
    "D3_batch_dedup": d3, "D4_history_dedup": d4, "D5_dedup_merge": d5, "D6_dedup_stats": d6, "D7_dedup_summary": d7, "D8_known_hash_filter": d8, "D9_insert_new": d9,
    "D10_replace_batch": d10, "D11_merge_scores": d11, "D12_merge_results": d12, "D13_repeat_body_bonus": d13,
    "D9_insert_new_stored": d9_stored, "D10_replace_batch_stored": d10_stored, "D11_merge_scores_stored": d11_stored, "D12_merge_results_stored": d12_stored,
}

BATCH = """
h AS (SELECT *, sha256(title || '|' || url) AS content_hash FROM articles_raw),
w AS (SELECT *, seq > min(seq) OVER (PARTITION BY content_hash) AS by_hash, seq > min(seq) OVER (PARTITION BY url) AS by_url FROM h),
batch AS (SELECT seq, content_hash, url, title, content, published_at, by_hash OR by_url AS is_duplicate, CASE WHEN by_url THEN url WHEN by_hash THEN content_hash END AS duplicate_of,
  array_to_string(list_filter([CASE WHEN by_hash THEN 'Duplicate content hash' END, CASE WHEN by_url THEN 'Duplicate URL' END,
    CASE WHEN length(title) BETWEEN 1 AND 9 THEN 'Title too short' END, CASE WHEN length(content) BETWEEN 1 AND 49 THEN 'Content too short' END], lambda x: x IS NOT NULL), '; ') AS issues FROM w)"""
KNOWN = """
known AS (SELECT sha256(title || '|' || url) AS content_hash, url FROM history WHERE created_at >= TIMESTAMP '2024-01-24' OR published_at >= TIMESTAMP '2024-01-24'),
k AS (SELECT *, sha256(title || '|' || url) IN (SELECT content_hash FROM known) AS kh, url IN (SELECT url FROM known) AS ku,
  coalesce(published_at < TIMESTAMP '2024-01-24', false) AS old, strftime(published_at, '%Y-%m-%d') AS day FROM articles_raw),
hist AS (SELECT seq, kh OR ku OR old AS is_duplicate,
  CASE WHEN ku THEN 'db_url:' || url WHEN kh THEN 'db_hash:' || sha256(title || '|' || url) WHEN old THEN 'old_article:' || day END AS duplicate_of,
  array_to_string(list_filter([CASE WHEN old THEN 'Article too old (published ' || day || ')' END, CASE WHEN kh THEN 'Duplicate in database (content)' END,
    CASE WHEN ku THEN 'Duplicate in database (URL)' END], lambda x: x IS NOT NULL), '; ') AS issues FROM k)"""
MERGED = f"""{BATCH}, {KNOWN},
v AS (SELECT b.seq, b.title, b.content, b.url, b.published_at, CASE WHEN h.is_duplicate THEN true ELSE b.is_duplicate END AS is_duplicate,
  CASE WHEN h.is_duplicate THEN h.duplicate_of ELSE b.duplicate_of END AS duplicate_of, CASE WHEN h.is_duplicate THEN h.issues ELSE b.issues END AS issues
  FROM batch b JOIN hist h USING (seq))"""
_HASH = "lower(issues) LIKE '%content hash%'"
QUALITY = """least(1.0, CASE WHEN length(title) >= 10 THEN 0.3::DOUBLE * least(length(title) / 100, 1.0) ELSE 0 END + CASE WHEN length(content) >= 50 THEN 0.5::DOUBLE * least(length(content) / 1000, 1.0) ELSE 0 END
  + CASE WHEN published_at IS NOT NULL THEN 0.1::DOUBLE * greatest(0.0, 1 - (epoch(TIMESTAMP '2024-01-31') - epoch(published_at)) / 3600 / 168) ELSE 0 END
  + 0.1::DOUBLE * greatest(0.5, 1 - 0.1::DOUBLE * (length(url) - length(regexp_replace(url, '[&?]', '', 'g')))))"""

SQL = {
    "D3_batch_dedup": f"WITH {BATCH} SELECT seq, content_hash, is_duplicate, duplicate_of, issues FROM batch",
    "D4_history_dedup": f"WITH {KNOWN} SELECT * FROM hist",
    "D5_dedup_merge": f"WITH {MERGED} SELECT seq, is_duplicate, duplicate_of, issues FROM v WHERE NOT is_duplicate",
    "D6_dedup_stats": f"""WITH {MERGED} SELECT count(*) AS total_articles, count_if(NOT is_duplicate)::BIGINT AS unique_articles, count_if(is_duplicate)::BIGINT AS duplicates_found,
      count_if(is_duplicate AND {_HASH})::BIGINT AS by_hash, count_if(is_duplicate AND NOT {_HASH} AND lower(issues) LIKE '%url%')::BIGINT AS by_url,
      count_if(is_duplicate AND NOT {_HASH} AND NOT lower(issues) LIKE '%url%')::BIGINT AS by_content, round(count_if(is_duplicate) / count(*) * 100, 6) AS deduplication_rate FROM v""",
    "D7_dedup_summary": f"""WITH {MERGED}, i AS (SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, '; ')) AS issue FROM v WHERE issues <> '') GROUP BY issue),
      t AS (SELECT count(*) AS total, count_if(is_duplicate)::BIGINT AS duplicates, count_if(NOT is_duplicate)::BIGINT AS "unique", round(count_if(is_duplicate) / count(*) * 100, 6) AS rate,
        round(avg(CASE WHEN NOT is_duplicate THEN {QUALITY} END), 6) AS average_quality FROM v)
      SELECT * FROM i, t""",
    "D8_known_hash_filter": "SELECT id, sha256(title || '|' || url) AS content_hash FROM incoming WHERE sha256(title || '|' || url) NOT IN (SELECT sha256(title || '|' || url) FROM history)",
    "D9_insert_new": """SELECT id, title, url, seq FROM history UNION ALL
      SELECT id, title, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM incoming) WHERE rn = 1 AND url NOT IN (SELECT url FROM history)""",
    "D10_replace_batch": """WITH b AS (SELECT *, max(seq) OVER (PARTITION BY id) AS i, max(seq) OVER (PARTITION BY url) AS u FROM incoming)
      SELECT id, title, url, seq FROM history WHERE id NOT IN (SELECT id FROM incoming) AND url NOT IN (SELECT url FROM incoming)
      UNION ALL SELECT id, title, url, seq FROM b WHERE seq = i AND seq = u""",
    "D11_merge_scores": """WITH st AS (SELECT url, arg_min(id, seq) AS id, arg_min(title, seq) AS title FROM history GROUP BY url),
      nw AS (SELECT url, arg_max(id, seq) AS id, arg_max(title, seq) AS title, max(seq) % 100 / 100 AS sc FROM incoming GROUP BY url)
      SELECT coalesce(st.id, nw.id) AS id, coalesce(st.title, nw.title) AS title, coalesce(st.url, nw.url) AS url,
        CASE WHEN nw.url IS NOT NULL THEN nw.sc ELSE 0.1 END::DOUBLE AS ai_relevance_score, CASE WHEN nw.url IS NOT NULL THEN 0.5 END::DOUBLE AS ai_confidence
      FROM st FULL JOIN nw ON st.url = nw.url""",
    "D12_merge_results": """WITH l AS (SELECT *, seq % 5 = 0 AS isnew FROM results_log), r AS (SELECT *, row_number() OVER (PARTITION BY article_id, chat_id, topic_name, isnew ORDER BY seq DESC) AS rn FROM l),
      o AS (SELECT * FROM r WHERE rn = 1 AND NOT isnew), n AS (SELECT * FROM r WHERE rn = 1 AND isnew)
      SELECT coalesce(o.article_id, n.article_id) AS article_id, coalesce(o.chat_id, n.chat_id) AS chat_id, coalesce(o.topic_name, n.topic_name) AS topic_name,
        coalesce(n.seq, o.seq) AS seq, coalesce(n.ai_relevance_score, o.ai_relevance_score) AS ai_relevance_score, coalesce(n.confidence_score, o.confidence_score) AS confidence_score,
        strftime(coalesce(n.processed_at, o.processed_at), '%Y-%m-%d %H:%M:%S') AS processed_at, coalesce(o.delivered, false) AS delivered
      FROM o FULL JOIN n ON o.article_id = n.article_id AND o.chat_id = n.chat_id AND o.topic_name = n.topic_name""",
    "D13_repeat_body_bonus": """WITH e AS (SELECT a.id, f.chat_id, t.topic_ord, md5(coalesce(content, '')) AS bh, -coalesce(epoch(published_at)::BIGINT, 0) AS age
        FROM articles_raw a JOIN feeds f ON a.source_feed = f.url JOIN topics t ON t.chat_id = f.chat_id AND t.active)
      SELECT id, chat_id, topic_ord, CASE WHEN row_number() OVER (PARTITION BY bh ORDER BY chat_id, topic_ord, age, id) > 1 THEN 0.05 ELSE 0.0 END::DOUBLE AS bonus FROM e""",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
SQL |= {f"{k}_stored": SQL[k] for k in ("D9_insert_new", "D10_replace_batch", "D11_merge_scores", "D12_merge_results")}
