"""Registered queries of topic matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.words import STOP_WORDS
from sheaf.operators import matching as op
from sheaf.plans.views import view, with_views
from sheaf.sources.stage import staged


def features(s, d):
    """Cleaned once and written: several joins read them, and would each clean all articles again. Of the tokens their number is enough."""
    return staged(op.text_features(view(s, d, "articles_raw")).drop("tokens"), "features")


def matched(s, d):
    """Features, and the hits of all topics' keywords in them."""
    f = features(s, d)
    return f, staged(op.topic_hits(f, view(s, d, "topic_keywords")), "hits", plain=True)


def topic_feeds(s, d):
    feeds = view(s, d, "feeds").select("chat_id", F.col("url").alias("source_feed"))
    return view(s, d, "topics").filter("active").join(feeds, "chat_id").select("chat_id", "name", "topic_ord", "source_feed")


def pairs(s, d):
    f, hits = matched(s, d)
    return staged(op.prefilter(f, view(s, d, "topic_keywords"), topic_feeds(s, d), hits), "pairs", plain=True)


def m1(s, d):
    return op.token_counts(view(s, d, "articles_raw")).select("id", "word", "n", F.round(F.col("n") / F.col("n_tokens"), 6).alias("tf"))


def m2(s, d):
    f, hits = matched(s, d)
    return op.relevance(f, view(s, d, "topic_keywords"), hits)


def m3(s, d):
    return op.exclusions(view(s, d, "topic_keywords"), op.topic_hits(op.text_features(view(s, d, "articles_raw")), view(s, d, "topic_keywords").filter("kind = 'exclude'")))


def m4(s, d):
    return pairs(s, d)


def _verdicts(s, d):
    """Pairs and the verdicts on articles."""
    f, hits = matched(s, d)
    p = staged(op.prefilter(f, view(s, d, "topic_keywords"), topic_feeds(s, d), hits), "pairs", plain=True)
    return p, op.verdicts(view(s, d, "articles_raw"), p, op.exclusions(view(s, d, "topic_keywords"), hits))


def m5(s, d):
    return _verdicts(s, d)[1].select("id", "passed", "chat_id", "best_topic", "best_score", "reason")


def m6(s, d):
    p, v = _verdicts(s, d)
    return op.topic_histogram(p).crossJoin(F.broadcast(op.summary(v)))  # one row


QUERIES = {"M1_text_features": m1, "M2_keyword_relevance": m2, "M3_exclusion": m3, "M4_prefilter": m4, "M5_best_topic": m5, "M6_prefilter_summary": m6}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
FEATURES = rf"""
ft AS MATERIALIZED (SELECT id, source_feed, trim(regexp_replace(regexp_replace(regexp_replace(lower(title || ' ' || coalesce(content, '')), '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM articles_raw),
tok AS MATERIALIZED (SELECT id, word FROM (SELECT id, unnest(string_split(t, ' ')) AS word FROM ft) WHERE length(word) > 2 AND word NOT IN ({_STOP})),
wc AS MATERIALIZED (SELECT id, word, count(*) AS w, sum(count(*)) OVER (PARTITION BY id) AS n FROM tok GROUP BY id, word)"""
SCORES = FEATURES + """,
inc AS (SELECT name, lower(trim(keyword)) AS k FROM topic_keywords WHERE kind = 'include'),
ks AS (SELECT f.id, i.name, i.k, (length(f.t) - length(replace(f.t, i.k, ''))) / length(i.k) AS c,
         list_filter(string_split(i.k, ' '), lambda x: length(x) > 2) AS kw FROM ft f CROSS JOIN inc i WHERE f.id IN (SELECT id FROM wc)),
kf AS (SELECT ks.*, (SELECT count(*) FROM wc WHERE wc.id = ks.id AND list_contains(ks.kw, wc.word)) AS found,
         (SELECT least(10 * sum(wc.w) / max(wc.n), 0.6::DOUBLE) FROM wc WHERE wc.id = ks.id AND list_contains(ks.kw, wc.word)) AS single FROM ks),
k2 AS (SELECT *, found = len(kw) AND len(kw) > 0 AS allw FROM kf),
k3 AS (SELECT id, name, greatest(CASE WHEN c > 0 THEN least(0.8::DOUBLE * c, 1) ELSE 0 END, CASE WHEN allw AND len(kw) > 1 THEN 0.4 WHEN allw THEN single ELSE 0 END) AS s,
         CAST(c > 0 AS INT) + CAST(allw AS INT) AS m FROM k2),
rel AS MATERIALIZED (SELECT id, name, round(least(sum(s) / count(*) + 0.2::DOUBLE * least(sum(m) / count(*), 1), 1), 6) AS score FROM k3 GROUP BY id, name HAVING sum(m) > 0)"""
EXC = """
exc AS MATERIALIZED (SELECT f.id, e.name, arg_min(lower(trim(e.keyword)), e.kw_ord) AS keyword FROM ft f JOIN topic_keywords e ON e.kind = 'exclude' AND contains(f.t, lower(trim(e.keyword))) GROUP BY f.id, e.name)"""
PAIRS = SCORES + "," + EXC + """,
pairs AS MATERIALIZED (SELECT r.id, t.chat_id, r.name, t.topic_ord, r.score, r.score >= 0.1 AS matched
  FROM rel r JOIN ft f ON f.id = r.id JOIN feeds d ON d.url = f.source_feed JOIN topics t ON t.active AND t.chat_id = d.chat_id AND t.name = r.name
  WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.id = r.id AND e.name = r.name))"""
VERDICTS = PAIRS + """,
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_ord, chat_id::INT) AS rn, count_if(matched) OVER (PARTITION BY id) AS nm FROM pairs),
fx AS (SELECT id, arg_min(keyword, name) AS keyword FROM exc GROUP BY id),
verdict AS (SELECT a.id, coalesce(b.nm > 0, false) AS passed, b.chat_id, b.name AS best_topic, b.score AS best_score,
  CASE WHEN b.nm > 0 THEN 'Matched ' || b.nm || ' topic(s)' WHEN fx.keyword IS NOT NULL THEN 'Excluded by keyword: ' || fx.keyword ELSE 'No matching topics' END AS reason
  FROM articles_raw a LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON a.id = b.id LEFT JOIN fx ON fx.id = a.id)"""

SQL = {
    "M1_text_features": f"WITH {FEATURES} SELECT id, word, w AS n, round(w / n, 6) AS tf FROM wc",
    "M2_keyword_relevance": f"WITH {SCORES} SELECT * FROM rel",
    "M3_exclusion": f"WITH {FEATURES}, {EXC} SELECT * FROM exc",
    "M4_prefilter": f"WITH {PAIRS} SELECT * FROM pairs",
    "M5_best_topic": f"WITH {VERDICTS} SELECT * FROM verdict",
    "M6_prefilter_summary": f"""WITH {VERDICTS}, h AS (SELECT name, count(DISTINCT id) AS n FROM pairs WHERE matched GROUP BY name)
      SELECT * FROM h, (SELECT count(*) AS total, count_if(passed)::BIGINT AS passed, round((count(*) - count_if(passed)) / count(*) * 100, 6) AS reduction FROM verdict)""",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
