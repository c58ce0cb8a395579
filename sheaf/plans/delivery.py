"""Registered queries of selection and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import digest as dg, selection as op, upserts
from sheaf.plans import matching as m
from sheaf.plans.views import now, view, with_views
from sheaf.sources.buckets import BucketTable
from sheaf.sources.stage import shared_path

A = lambda s, d: view(s, d, "articles_raw")


def _results(s, d):
    return view(s, d, "processing_results").withColumn("processed_at", F.col("processed_at").cast("timestamp"))


def _delivery(s, d, k=5):
    return op.deliverable(_results(s, d), A(s, d), view(s, d, "topics"), now(), k)


def _owned(s, d):
    t = view(s, d, "topics")
    return t.withColumn("telegram_user_id", F.when(F.col("topic_ord") % 2 == 0, F.col("chat_id").cast("bigint") + F.col("topic_ord")))


def j1(s, d):
    done = view(s, d, "processing_results").filter("seq % 2 = 0")
    return op.unprocessed(A(s, d), view(s, d, "feeds"), done, now()).withColumn("created_at", tx.stamp(F.col("created_at")))


def j2(s, d):
    p = m.pairs(s, d).filter("matched").join(A(s, d).select("id", "published_at"), "id")
    return op.candidates(p).select("chat_id", "name", "rank", "id", "score")


def j3(s, d):
    return _delivery(s, d).select("chat_id", "topic_name", "rank", "article_id", "ai_relevance_score")


def j4(s, d):
    return op.by_feed(A(s, d), 3).select("source_feed", "rank", "id")


def j5(s, d):
    return op.recent(A(s, d), now(), 24, 50).select("id")


def j6(s, d):
    return op.topics_of_users(_owned(s, d), view(s, d, "channels"))


def j7(s, d):
    queries = view(s, d, "topics").select(F.substring("name", 2, 3).alias("query")).distinct()
    return op.search_topics(view(s, d, "topics"), view(s, d, "topic_keywords"), queries)


def j9(s, d):
    c = view(s, d, "channels").withColumn("chat_type", F.when(F.col("chat_id").isin("1", "3"), "private").otherwise(F.col("chat_type")))
    o = op.owners(_owned(s, d), c)
    new = op.missing_users(o, view(s, d, "users").filter("telegram_user_id % 2 = 0"))
    return o.join(new.select(F.col("telegram_user_id").alias("owner"), F.lit(True).alias("to_create")), "owner", "left").select("chat_id", "name", "owner", "outcome", F.coalesce("to_create", F.lit(False)).alias("to_create"))


def j10(s, d):
    return op.channels_due(view(s, d, "feeds"))


def j11(s, d):
    return op.preview(_delivery(s, d, 3), A(s, d))


def f1(s, d):
    return dg.items(_delivery(s, d), A(s, d), now())


def f2(s, d):
    return dg.messages(dg.items(_delivery(s, d), A(s, d), now()), 900)


def f3(s, d):
    return dg.headers(_delivery(s, d))


def f4(s, d):
    return dg.topic_preview(_delivery(s, d), A(s, d))


def _with_channels(s, d, marked, sent):
    ch = dg.mark_channels(view(s, d, "channels"), sent, now()).select("chat_id", tx.stamp(F.col("last_delivery_at")).alias("last_delivery_at"))
    return marked.select("article_id", "chat_id", "topic_name", "delivered").join(ch, "chat_id")


def f5(s, d):
    sent = _delivery(s, d)
    return _with_channels(s, d, dg.mark_delivered(_results(s, d), sent), sent)


def f5_stored(s, d):
    """F5 in a table of buckets by article, channel and topic."""
    sent = _delivery(s, d)
    t = BucketTable(s, shared_path(s, "results"), ["article_id", "chat_id", "topic_name"]).create(_results(s, d), 32)
    upserts.mark_delivered(t, sent)
    return _with_channels(s, d, t.read(), sent)


QUERIES = {
    "J1_unprocessed": j1, "J2_candidates_topk": j2, "J3_delivery_topk": j3, "J4_articles_by_feed": j4, "J5_recent_articles": j5, "J6_user_topics": j6, "J7_topic_search": j7, "J9_assign_owners": j9,
    "J10_channels_due": j10, "J11_preview": j11, "F1_digest_items": f1, "F2_pack_messages": f2, "F3_digest_header": f3, "F4_topic_preview": f4, "F5_mark_delivered": f5, "F5_mark_delivered_stored": f5_stored,
}


def _trunc(c, n):
    last = f"(CASE WHEN instr(reverse(substr({c}, 1, {n - 3})), ' ') > 0 THEN length(substr({c}, 1, {n - 3})) - instr(reverse(substr({c}, 1, {n - 3})), ' ') ELSE -1 END)"
    return f"(CASE WHEN length({c}) <= {n} THEN {c} WHEN {last} > {n // 2} THEN substr({c}, 1, {last}) || '...' ELSE substr({c}, 1, {n - 3}) || '...' END)"


def DEL(k):
    return f"""del AS MATERIALIZED (SELECT * FROM (SELECT r.*, a.title, a.published_at, row_number() OVER (PARTITION BY r.chat_id, r.topic_name ORDER BY r.ai_relevance_score DESC, a.published_at DESC NULLS LAST, r.article_id) AS rank
      FROM processing_results r JOIN topics t ON t.chat_id = r.chat_id AND t.name = r.topic_name JOIN articles_raw a ON a.id = r.article_id
      WHERE NOT r.delivered AND r.processed_at >= TIMESTAMP '2024-01-30' AND r.confidence_score >= t.confidence_threshold) WHERE rank <= {k})"""


ITEMS = rf"""{DEL(5)},
pv AS (SELECT id, source_feed, trim(regexp_replace(coalesce(content, ''), '{tx.SPACE}', ' ', 'g')) AS t FROM articles_raw),
pe AS (SELECT *, substr(t, 1, 200) AS h FROM pv),
pf AS (SELECT *, greatest(""" + ", ".join(f"CASE WHEN contains(h, '{c}') THEN 200 - instr(reverse(h), '{c}') ELSE -1 END" for c in ".!?") + rf""") AS e FROM pe),
ps AS (SELECT id, CASE WHEN length(t) <= 200 THEN t WHEN e > 140 THEN substr(t, 1, e + 1) ELSE substr(t, 1, 197) || '...' END AS text,
  split_part(regexp_replace(regexp_extract(source_feed, 'https?://([^/]+)', 1), '^www\.', ''), '.', 1) AS l FROM pf),
it AS (SELECT d.chat_id, d.topic_name, d.rank, d.rank || '. ' || {_trunc('d.title', 120)} || chr(10) || chr(10) || CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END
  || coalesce(CASE WHEN a.published_at::DATE = DATE '2024-01-31' THEN 'Today ' || strftime(a.published_at, '%H:%M') ELSE strftime(a.published_at, '%m/%d %H:%M') END || ' - ', '') || upper(substr(l, 1, 1)) || lower(substr(l, 2)) || chr(10)
  || 'Read: ' || a.url || chr(10) || chr(10) || '{dg.RULE}' || chr(10) || chr(10) AS item FROM del d JOIN articles_raw a ON a.id = d.article_id JOIN ps ON ps.id = a.id)"""

OWNED = "ow AS (SELECT *, CASE WHEN topic_ord % 2 = 0 THEN chat_id::BIGINT + topic_ord END AS telegram_user_id FROM topics)"

SQL = {
    "J1_unprocessed": """SELECT a.id, f.chat_id, strftime(a.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM articles_raw a JOIN feeds f ON f.url = a.source_feed
      LEFT JOIN (SELECT DISTINCT article_id, chat_id FROM processing_results WHERE seq % 2 = 0) r ON r.article_id = a.id AND r.chat_id = f.chat_id
      WHERE r.article_id IS NULL AND a.created_at >= TIMESTAMP '2024-01-29'""",
    "J2_candidates_topk": f"""WITH {m.PAIRS} SELECT chat_id, name, rank, id, score FROM (SELECT p.*, row_number() OVER (PARTITION BY chat_id, name ORDER BY published_at DESC NULLS LAST, p.id) AS rank
      FROM pairs p JOIN articles_raw a ON a.id = p.id WHERE matched) WHERE rank <= 5""",
    "J3_delivery_topk": f"WITH {DEL(5)} SELECT chat_id, topic_name, rank, article_id, ai_relevance_score FROM del",
    "J4_articles_by_feed": "SELECT source_feed, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY source_feed ORDER BY created_at DESC, seq) AS rank FROM articles_raw) WHERE rank <= 3",
    "J5_recent_articles": "SELECT id FROM articles_raw WHERE created_at >= TIMESTAMP '2024-01-30' ORDER BY created_at DESC, seq LIMIT 50",
    "J6_user_topics": f"WITH {OWNED} SELECT telegram_user_id, chat_id, chat_title, name FROM ow JOIN channels USING (chat_id) WHERE ow.active AND telegram_user_id IS NOT NULL",
    "J7_topic_search": """SELECT DISTINCT q.query, t.chat_id, t.name FROM (SELECT DISTINCT substr(name, 2, 3) AS query FROM topics) q JOIN topics t ON t.active
      AND (contains(t.name, q.query) OR EXISTS (SELECT 1 FROM topic_keywords k WHERE k.name = t.name AND k.kind = 'include' AND contains(lower(k.keyword), q.query)))""",
    "J9_assign_owners": f"""WITH {OWNED}, o AS (SELECT ow.chat_id, name, CASE WHEN (c.chat_type = 'private' OR c.chat_id IN ('1', '3')) AND c.chat_id::BIGINT > 0 THEN c.chat_id::BIGINT END AS owner
        FROM ow LEFT JOIN channels c USING (chat_id) WHERE ow.active AND telegram_user_id IS NULL)
      SELECT chat_id, name, owner, CASE WHEN owner IS NOT NULL THEN 'assigned' ELSE 'orphaned' END AS outcome,
        owner IS NOT NULL AND owner NOT IN (SELECT telegram_user_id FROM users WHERE telegram_user_id % 2 = 0) AS to_create FROM o""",
    "J10_channels_due": "SELECT DISTINCT chat_id FROM feeds WHERE active",
    "J11_preview": f"""WITH {DEL(3)} SELECT chat_id, topic_name, count(*) AS total,
        array_to_string(list({_trunc('title', 60)} ORDER BY rank)[1:2], chr(10)) || CASE WHEN count(*) > 2 THEN chr(10) || '... and ' || (count(*) - 2) || ' more' ELSE '' END AS text FROM del GROUP BY ALL""",
    "F1_digest_items": f"WITH {ITEMS} SELECT chat_id, topic_name, rank, item FROM it",
    "F2_pack_messages": rf"""WITH RECURSIVE {ITEMS}, g AS (SELECT chat_id, topic_name, list(item ORDER BY rank) AS items FROM it GROUP BY ALL),
      pk AS (SELECT chat_id, topic_name, items, 0 AS k, []::VARCHAR[] AS done, topic_name || chr(10) || chr(10) AS cur FROM g
        UNION ALL SELECT chat_id, topic_name, items, k + 1, CASE WHEN length(cur) + length(items[k + 1]) > 900 THEN list_append(done, regexp_replace(cur, '\s+$', '')) ELSE done END,
          CASE WHEN length(cur) + length(items[k + 1]) > 900 THEN topic_name || ' (continued)' || chr(10) || chr(10) || items[k + 1] ELSE cur || items[k + 1] END FROM pk WHERE k < len(items)),
      fin AS (SELECT chat_id, topic_name, list_append(done, regexp_replace(cur, '\s+$', '')) AS m FROM pk WHERE k = len(items))
      SELECT chat_id, topic_name, generate_subscripts(m, 1)::INT AS message_no, unnest(m) AS message FROM fin""",
    "F3_digest_header": f"""WITH {DEL(5)}, p AS (SELECT chat_id, topic_name, count(*) AS n FROM del GROUP BY ALL),
      g AS (SELECT chat_id, sum(n)::BIGINT AS articles, count(*) AS topics, list(topic_name || ': ' || n || ' articles' ORDER BY topic_name || ': ' || n || ' articles') AS lines FROM p GROUP BY ALL)
      SELECT chat_id, articles, topics, greatest(1.0, articles * 0.5)::DOUBLE AS minutes, 'Daily digest: ' || articles || ' articles from ' || topics || CASE WHEN topics = 1 THEN ' topic' ELSE ' topics' END || ', '
        || ceil(greatest(1.0, articles * 0.5))::BIGINT || ' min' || chr(10) || array_to_string(lines, chr(10)) AS header FROM g""",
    "F4_topic_preview": f"""WITH {DEL(5)}, l AS (SELECT chat_id, topic_name, rank, rank || '. ' || {_trunc('title', 70)} || coalesce(' - ' || strftime(published_at, '%m/%d'), '') AS line FROM del),
      g AS (SELECT chat_id, topic_name, count(*) AS n, list(line ORDER BY rank) AS lines FROM l GROUP BY chat_id, topic_name)
      SELECT chat_id, topic_name, topic_name || ' preview' || chr(10) || array_to_string(lines[1:3], chr(10)) || CASE WHEN n > 3 THEN chr(10) || '... and ' || (n - 3) || ' more articles' ELSE '' END AS preview FROM g""",
    "F5_mark_delivered": f"""WITH {DEL(5)} SELECT r.article_id, r.chat_id, r.topic_name, r.delivered OR d.article_id IS NOT NULL AS delivered,
        CASE WHEN r.chat_id IN (SELECT chat_id FROM del) THEN '2024-01-31 00:00:00' END AS last_delivery_at
      FROM processing_results r LEFT JOIN del d ON d.article_id = r.article_id AND d.chat_id = r.chat_id AND d.topic_name = r.topic_name JOIN channels c ON c.chat_id = r.chat_id""",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
SQL["F5_mark_delivered_stored"] = SQL["F5_mark_delivered"]
