"""Registered queries of scoring, routing and acceptance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sheaf.functions import words as w
from sheaf.operators import dedup, scoring as op
from sheaf.plans import dedup as dedup_plans, matching as m
from sheaf.plans.views import now, view, with_views
from sheaf.sources.stage import staged

A = lambda s, d: view(s, d, "articles_raw")


def text_hits(s, d, *surfaces):
    """Keywords in the articles' own texts, looked up once for all that a query derives from them."""
    return staged(op.text_hits(A(s, d), view(s, d, "topic_keywords"), surfaces=surfaces), "text-hits", plain=True)


def _weighted(s, d, pairs, found):
    return op.weighted_keywords(pairs.select("id", "chat_id", "name"), found, view(s, d, "topic_keywords"))


def _bonus(quality, pairs):
    body = quality.select("id", "published_at", "body_hash")
    e = pairs.select("id", "chat_id", "name", "topic_ord").join(body, "id").withColumn("age", -F.coalesce(F.unix_timestamp("published_at"), F.lit(0)))
    return dedup.repeat_bonus(e, [F.col(c) for c in ("chat_id", "topic_ord", "age", "id")]).select("id", "chat_id", "name", "bonus")


def _routed(s, d, pairs=None, found=None):
    pairs, found = m.pairs(s, d) if pairs is None else pairs, text_hits(s, d, "full") if found is None else found
    quality = staged(op.article_quality(A(s, d)), "quality", plain=True)
    return op.routed(_weighted(s, d, pairs, found), quality, _bonus(quality, pairs))


def m7(s, d):
    return _weighted(s, d, m.pairs(s, d), text_hits(s, d, "full")).withColumn("matched", F.array_join("matched", ","))


def m8(s, d):
    return A(s, d).select("id", op.content_quality().alias("content_q"))


def m9(s, d):
    u = F.concat("url", F.when(F.col("seq") % 3 == 0, "/docs/x").when(F.col("seq") % 4 == 0, "/ad/sponsored").when(F.col("seq") % 5 == 0, "/news/github.com").otherwise(""))
    return A(s, d).select("id", op.url_quality(u).alias("url_q"))


def m10(s, d):
    return _routed(s, d).select("id", "chat_id", "name", "relevance")


def m11(s, d):
    return _routed(s, d).select("id", "chat_id", "name", "confidence")


def m12(s, d):
    return _routed(s, d).select("id", "chat_id", "name", "routing", "action")


def _fallback(s, d, pairs=None, found=None):
    return op.fallback(m.pairs(s, d) if pairs is None else pairs, text_hits(s, d, "plain") if found is None else found, view(s, d, "topic_keywords"))


def m13(s, d):
    return _fallback(s, d)


def m14(s, d):
    return A(s, d).select("id", F.round(dedup.quality(now()), 6).alias("quality"))


def m15(s, d):
    t = view(s, d, "topics").select("chat_id", F.concat("name", F.when(F.col("topic_ord") % 2 == 0, " Of Many Things").otherwise("")).alias("name"))
    return t.select("chat_id", "name", F.array_join(op.generated_keywords(F.col("name")), ",").alias("keywords"))


def m16(s, d):
    text = F.concat_ws("\n", F.when(F.col("seq") % 10 != 0, F.concat(F.lit("RELEVANCE_SCORE: "), (F.col("relevance") * 1.2).cast("decimal(20,4)"))).otherwise("RELEVANCE_SCORE: none"),
                       F.concat(F.lit("CONFIDENCE: "), F.col("confidence").cast("decimal(20,4)")), F.concat(F.lit("MATCHED_KEYWORDS: "), "topic_name", F.lit(", , "), "provider"), F.concat(F.lit("REASONING: seen "), "article_id"))
    r = view(s, d, "call_log").select("seq", text.alias("text"))
    return r.select("seq", *[c.alias(k) for k, c in op.parsed_response(F.col("text")).items()])


def _factors(s):
    return s.createDataFrame(list(w.PROVIDER_FACTORS.items()), "provider string, factor double")


def m17(s, d):
    calls = view(s, d, "call_log").withColumn("provider", F.when(F.col("seq") % 3 == 0, "keyword_fallback").when(F.col("seq") % 7 == 0, "other").otherwise(F.col("provider")))
    return op.quality_adjusted(calls.select("seq", "provider", "relevance", "confidence"), _factors(s))


def _ladder(s, d, fallbacks):
    order = s.createDataFrame([(p, i) for i, p in enumerate(w.PROVIDER_ORDER)], "provider string, position int")
    fb = fallbacks.groupBy(F.col("id").alias("article_id"), F.col("name").alias("topic_name")).agg(F.max("relevance").alias("relevance"), F.max("confidence").alias("confidence"))
    calls = view(s, d, "call_log").select("article_id", "topic_name", "seq", "provider", (F.col("success") & (F.col("seq") % 3 == 0)).alias("success"), F.round("relevance", 6).alias("relevance"), "confidence")
    return op.ladder(calls, order, fb)


def m18(s, d):
    return _ladder(s, d, _fallback(s, d))


def m19(s, d):
    q = op.combined_quality(F.col("relevance"), F.col("confidence"))
    return view(s, d, "call_log").select("seq", q.alias("quality"), (q >= 0.7).alias("is_relevant"))


def accepted(s, d, pairs):
    """Routed pairs and fallback scores are written: each is read several times, and the broadcasts of their joins are free before the next begin."""
    found = text_hits(s, d, "full", "plain")
    r, fb = staged(_routed(s, d, pairs, found), "routed", plain=True), staged(_fallback(s, d, pairs, found), "fallback", plain=True)
    adjusted = op.quality_adjusted(_ladder(s, d, fb), _factors(s)).select(F.col("article_id").alias("id"), F.col("topic_name").alias("name"), "provider", "relevance", "confidence")
    keys = r.select("id", "chat_id", "name")
    model = keys.join(adjusted, ["id", "name"]).filter(F.col("id").cast("long") % 5 != 0)
    failed = fb.filter(F.col("id").cast("long") % 5 == 0).withColumn("provider", F.lit("keyword_fallback"))
    return op.accepted(r, model, failed)


def m20(s, d):
    return accepted(s, d, m.pairs(s, d))


QUERIES = {
    "M7_weighted_keywords": m7, "M8_content_quality": m8, "M9_url_quality": m9, "M10_composite": m10, "M11_confidence": m11, "M12_route": m12, "M13_fallback_score": m13,
    "M14_article_quality": m14, "M15_generate_keywords": m15, "M16_parse_responses": m16, "M17_quality_adjust": m17, "M18_fallback_ladder": m18, "M19_combined_quality": m19, "M20_accept": m20,
}

_q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_esc = lambda x: x.replace("'", "''")
TEXT = "lower(coalesce(title, '') || '  ' || coalesce(content, ''))"
_theme = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'''contains(lower(name), '{t}')''' for t in tests)} THEN CASE WHEN n > 0 AND NOT list_has_any(matched, [{_q(members)}]) THEN 0.3 ELSE 1.0 END" for tests, members in w.THEMES) + " ELSE 1.0 END"
CQ = ("round(greatest(0, least(1, 0.5 + " + " + ".join(f"0.15::DOUBLE * regexp_matches({TEXT}, '{p}')::INT" for p in w.HIGH_CONTENT) + " - (" + " + ".join(f"0.1::DOUBLE * regexp_matches({TEXT}, '{p}')::INT" for p in w.LOW_CONTENT)
      + ") + CASE WHEN length(content) BETWEEN 500 AND 3000 THEN 0.1 WHEN length(coalesce(content, '')) < 100 THEN -0.2 ELSE 0 END)), 6)::DOUBLE")


def _uq(u):
    good = " OR ".join(f"contains(lower({u}), '{x}')" for x in w.GOOD_DOMAINS)
    return (f"round(greatest(0, least(1, 0.5 + CASE WHEN {good} THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(lower({u}), '{_esc(w.BAD_URL)}') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower({u}), '/docs/') OR contains(lower({u}), '/documentation/') THEN 0.2"
            f" WHEN contains(lower({u}), '/blog/') OR contains(lower({u}), '/news/') THEN 0.1 WHEN contains(lower({u}), '/ad/') OR contains(lower({u}), '/promo/') THEN -0.3 ELSE 0 END)), 6)::DOUBLE")


WEIGHTED = m.PAIRS + f""",
lowered AS (SELECT id, {TEXT} AS tx FROM articles_raw),
pk AS (SELECT p.id, p.name, k.kw_ord, lower(trim(k.keyword)) AS kw, a.tx, CASE WHEN lower(trim(k.keyword)) IN ({_q(op.GENERIC)}) THEN 0.3 ELSE 1.0 END::DOUBLE AS g
  FROM (SELECT DISTINCT id, name FROM pairs) p JOIN topic_keywords k ON k.name = p.name AND k.kind = 'include' JOIN lowered a ON a.id = p.id),
p2 AS (SELECT *, (length(tx) - length(replace(tx, kw, ''))) / length(kw) AS c, contains(kw, ' ') AS multi, string_split(kw, ' ') AS ws FROM pk),
p3 AS (SELECT *, len(list_filter(ws, lambda x: contains(tx, x))) AS n_in FROM p2),
p4 AS (SELECT id, name, kw_ord, kw, g, CASE WHEN multi AND c > 0 THEN 0.8::DOUBLE * 1.5::DOUBLE * g WHEN multi THEN n_in / len(ws) * 0.4::DOUBLE * g WHEN c > 0 THEN least(0.1::DOUBLE * c, 0.6::DOUBLE) * g ELSE 0 END AS s,
  c > 0 OR (multi AND n_in = len(ws)) AS hit FROM p3),
p5 AS (SELECT id, name, sum(s) AS s, count_if(hit) AS n, bool_or(hit AND g = 1) AS spec, coalesce(list(kw ORDER BY kw_ord) FILTER (hit), []) AS matched FROM p4 GROUP BY id, name),
p6 AS (SELECT id, name, n::BIGINT AS n_matched, matched, round(least(1, s * CASE WHEN n > 1 THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN n > 0 AND NOT spec THEN 0.1 ELSE 1.0 END::DOUBLE
  * CASE WHEN n = 1 AND list_has_any(matched, [{_q(w.AMBIGUOUS)}]) THEN 0.4 ELSE 1.0 END::DOUBLE * ({_theme})::DOUBLE), 6)::DOUBLE AS score FROM p5),
weighted AS MATERIALIZED (SELECT p.id, p.chat_id, p.name, p.topic_ord, w.score, w.n_matched, array_to_string(w.matched, ',') AS matched FROM pairs p JOIN p6 w ON w.id = p.id AND w.name = p.name)"""
ROUTED = WEIGHTED + f""",
q AS MATERIALIZED (SELECT id, {CQ} AS cq, {_uq('url')} AS uq, md5(coalesce(content, '')) AS bh, -coalesce(epoch(published_at)::BIGINT, 0) AS age FROM articles_raw),
b AS (SELECT w.*, q.cq, q.uq, CASE WHEN row_number() OVER (PARTITION BY q.bh ORDER BY w.chat_id, w.topic_ord, q.age, w.id) > 1 THEN 0.05 ELSE 0 END::DOUBLE AS bonus FROM weighted w JOIN q ON q.id = w.id),
c AS (SELECT *, round(greatest(0, least(1, 0.6::DOUBLE * score + 0.5::DOUBLE * cq + 0.1::DOUBLE * uq + bonus)), 6)::DOUBLE AS relevance,
  round(greatest(0.1, least(1, 0.6::DOUBLE * CASE WHEN score > 0.8 AND n_matched >= 2 THEN 0.9 WHEN score > 0.5 AND n_matched >= 1 THEN 0.7 WHEN score > 0.2 THEN 0.4 ELSE 0.1 END
    + 0.2::DOUBLE * CASE WHEN cq > 0.7 THEN 0.8 WHEN cq > 0.4 THEN 0.6 ELSE 0.3 END + 0.2::DOUBLE * CASE WHEN uq > 0.7 THEN 0.7 WHEN uq > 0.4 THEN 0.5 ELSE 0.2 END)), 6)::DOUBLE AS confidence FROM b),
e AS (SELECT *, CASE WHEN confidence >= 0.8 THEN CASE WHEN relevance >= 0.7 THEN 'high_confidence' WHEN relevance <= 0.3 THEN 'low_confidence' ELSE 'uncertain' END
  WHEN confidence >= 0.6 THEN CASE WHEN relevance >= 0.8 THEN 'high_confidence' WHEN relevance <= 0.2 THEN 'low_confidence' ELSE 'uncertain' END
  WHEN confidence <= 0.3 AND relevance <= 0.35 THEN 'definitely_irrelevant' ELSE 'uncertain' END AS routing FROM c),
routed AS MATERIALIZED (SELECT *, CASE WHEN routing = 'high_confidence' AND relevance >= 0.7 THEN 'accept' WHEN routing = 'low_confidence' AND relevance <= 0.3 THEN 'reject' ELSE 'model' END AS action FROM e)"""
#: Without what other articles add.
ROUTED_ALONE = re.sub(r"CASE WHEN row_number\(\) OVER \(PARTITION BY q\.bh .*? AS bonus", "0::DOUBLE AS bonus", ROUTED)
FALLBACK = """,
fa AS (SELECT p.id, p.name, count_if(k.kind = 'include' AND contains(l.tx, lower(k.keyword))) AS nm, count_if(k.kind = 'include') AS n, bool_or(k.kind = 'exclude' AND contains(l.tx, lower(k.keyword))) AS ex
  FROM (SELECT DISTINCT id, name FROM pairs) p JOIN topic_keywords k ON k.name = p.name JOIN (SELECT id, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS tx FROM articles_raw) l ON l.id = p.id GROUP BY p.id, p.name),
fb AS MATERIALIZED (SELECT p.id, p.chat_id, p.name, round(CASE WHEN ex THEN nm / n * 0.3::DOUBLE ELSE least(0.8, nm / n * 0.7::DOUBLE) END, 6)::DOUBLE AS relevance, round(least(0.6, nm / n), 6)::DOUBLE AS confidence, nm::BIGINT AS n_matched
  FROM pairs p JOIN fa ON fa.id = p.id AND fa.name = p.name WHERE n > 0)"""
LADDER = """,
ok AS (SELECT *, row_number() OVER (PARTITION BY article_id, topic_name ORDER BY CASE provider WHEN 'groq' THEN 0 WHEN 'deepseek' THEN 1 WHEN 'gemini' THEN 2 ELSE 3 END, seq DESC) AS rn FROM call_log WHERE success AND seq % 3 = 0),
fbt AS (SELECT id AS article_id, name AS topic_name, max(relevance) AS relevance, max(confidence) AS confidence FROM fb GROUP BY id, name),
lad AS MATERIALIZED (SELECT article_id, topic_name, provider, round(relevance, 6) AS relevance, confidence FROM ok WHERE rn = 1
  UNION ALL SELECT article_id, topic_name, 'keyword_fallback', relevance, confidence FROM fbt f WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.article_id = f.article_id AND ok.topic_name = f.topic_name))"""
FACTOR = "CASE provider WHEN 'keyword_fallback' THEN 0.45 ELSE 1.0 END::DOUBLE"
ACCEPTED = f"""{ROUTED} {FALLBACK} {LADDER},
adj AS (SELECT article_id, topic_name, provider, round(relevance * {FACTOR}, 6) AS relevance, round(confidence * {FACTOR}, 6) AS confidence FROM lad),
accepted AS (SELECT id, chat_id, name, relevance, confidence, 'smart_routing' AS provider, false AS summarize FROM routed WHERE action = 'accept'
  UNION ALL SELECT r.id, r.chat_id, r.name, a.relevance, a.confidence, a.provider, a.relevance >= 0.6 FROM routed r JOIN adj a ON a.article_id = r.id AND a.topic_name = r.name
    WHERE r.action = 'model' AND r.id::BIGINT % 5 <> 0 AND a.relevance >= 0.5
  UNION ALL SELECT f.id, f.chat_id, f.name, f.relevance, least(f.confidence, 0.6), 'keyword_backup', false FROM fb f JOIN routed r ON r.id = f.id AND r.chat_id = f.chat_id AND r.name = f.name
    WHERE r.action = 'model' AND f.id::BIGINT % 5 = 0 AND f.relevance >= 0.3)"""

SQL = {
    "M7_weighted_keywords": f"WITH {WEIGHTED} SELECT id, chat_id, name, score, n_matched, matched FROM weighted",
    "M8_content_quality": f"SELECT id, {CQ} AS content_q FROM articles_raw",
    "M9_url_quality": f"SELECT id, {_uq('u')} AS url_q FROM (SELECT id, url || CASE WHEN seq % 3 = 0 THEN '/docs/x' WHEN seq % 4 = 0 THEN '/ad/sponsored' WHEN seq % 5 = 0 THEN '/news/github.com' ELSE '' END AS u FROM articles_raw)",
    "M10_composite": f"WITH {ROUTED} SELECT id, chat_id, name, relevance FROM routed",
    "M11_confidence": f"WITH {ROUTED} SELECT id, chat_id, name, confidence FROM routed",
    "M12_route": f"WITH {ROUTED} SELECT id, chat_id, name, routing, action FROM routed",
    "M13_fallback_score": f"WITH {m.PAIRS} {FALLBACK} SELECT * FROM fb",
    "M14_article_quality": f"SELECT id, round({dedup_plans.QUALITY}, 6) AS quality FROM articles_raw",
    "M15_generate_keywords": """SELECT chat_id, name, array_to_string((CASE WHEN contains(name, ' ') THEN list_concat([lower(name)], string_split(lower(name), ' ')[1:5], [lower(name) || ' technology'])
        ELSE [lower(name), lower(name) || ' technology', lower(name) || ' development', lower(name) || ' tools'] END)[1:7], ',') AS keywords
      FROM (SELECT chat_id, name || CASE WHEN topic_ord % 2 = 0 THEN ' Of Many Things' ELSE '' END AS name FROM topics)""",
    "M16_parse_responses": """SELECT seq, CASE WHEN seq % 10 = 0 THEN 0 ELSE least(1, (relevance * 1.2::DOUBLE)::DECIMAL(20,4)::DOUBLE) END::DOUBLE AS relevance, confidence::DECIMAL(20,4)::DOUBLE AS confidence,
        topic_name || ',' || provider AS keywords, 'seen ' || article_id AS reasoning FROM call_log""",
    "M17_quality_adjust": f"""SELECT seq, provider, round(relevance * {FACTOR}, 6) AS relevance, round(confidence * {FACTOR}, 6) AS confidence
      FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'keyword_fallback' WHEN seq % 7 = 0 THEN 'other' ELSE provider END AS provider, relevance, confidence FROM call_log)""",
    "M18_fallback_ladder": f"WITH {m.PAIRS} {FALLBACK} {LADDER} SELECT * FROM lad",
    "M19_combined_quality": "SELECT seq, round(0.7::DOUBLE * relevance + 0.3::DOUBLE * confidence, 6) AS quality, round(0.7::DOUBLE * relevance + 0.3::DOUBLE * confidence, 6) >= 0.7 AS is_relevant FROM call_log",
    "M20_accept": f"WITH {ACCEPTED} SELECT * FROM accepted",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
