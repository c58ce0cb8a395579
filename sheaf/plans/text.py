"""Registered queries over titles, texts and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.plans.views import view, with_views

A = lambda s, d: view(s, d, "articles_raw")


def h5(s, d):
    return A(s, d).select("id", tx.clean_valid(F.col("content")).alias("valid"))


def h7(s, d):
    return A(s, d).select("id", tx.sanitize(F.col("title")).alias("title"), F.md5(tx.sanitize(F.col("content"))).alias("content_md5"))


def h9(s, d):
    return A(s, d).select("id", tx.clean_title(F.concat(F.lit("[News] Report: "), "title", F.lit(" | Site"))).alias("framed"), tx.clean_title(F.concat("title", F.lit(" - Daily Post"))).alias("dashed"))


def h10(s, d):
    return A(s, d).select("id", tx.normalize_url(F.col("url")).alias("url"))


def h11(s, d):
    u = F.when(F.col("seq") % 9 == 0, F.concat(F.lit("ftp://"), F.substring("url", 9, 1000))).when(F.col("seq") % 10 == 0, F.upper("url")).when(F.col("seq") % 8 == 0, F.lit("http://localhost/x")).otherwise(F.col("url"))
    return A(s, d).select("id", tx.url_problem(u).alias("problem"), tx.canonical_url(u).alias("url"))


def h12(s, d):
    feeds = view(s, d, "feeds").select(F.col("url"))
    return A(s, d).select("url").union(feeds).select("url", F.lower("url").rlike(tx.FEED_URL).alias("likely"))


def h13(s, d):
    return A(s, d).select("id", tx.truncate(F.col("title"), 60).alias("title"))


def h14(s, d):
    return A(s, d).select("id", tx.preview(F.col("content"), 200).alias("preview"))


def h15(s, d):
    return A(s, d).select("id", tx.source_name(F.col("source_feed")).alias("source"))


def h16(s, d):
    return A(s, d).select("id", tx.extractive_summary(F.col("content"), F.col("title")).alias("summary"))


def h17(s, d):
    words = F.coalesce(F.least(tx.word_count(F.col("content")), F.lit(300)), F.lit(100)) + tx.word_count(F.col("title"))
    return A(s, d).groupBy("source_feed").agg(F.floor(F.greatest(F.lit(1.0), F.sum(words) / 200)).cast("long").alias("minutes"))


def d1(s, d):
    return A(s, d).select("id", tx.content_hash(F.col("title"), F.col("url")).alias("content_hash"))


def d2(s, d):
    return A(s, d).select("id", tx.body_hash(F.col("content"), F.lit(None).cast("string")).alias("body_hash"))


QUERIES = {
    "H5_clean_valid": h5, "H7_sanitize_text": h7, "H9_clean_title": h9, "H10_normalize_url": h10, "H11_validate_url": h11, "H12_likely_feed_url": h12, "H13_truncate_text": h13,
    "H14_content_preview": h14, "H15_source_name": h15, "H16_extractive_summary": h16, "H17_reading_time": h17, "D1_content_hash": d1, "D2_body_hash": d2,
}

_SP = r"[\s\x0B\x{00A0}]+"


def _collapse(c):
    return f"trim(regexp_replace({c}, '{_SP}', ' ', 'g'))"


def _last(c, one):
    return f"(CASE WHEN instr(reverse({c}), '{one}') > 0 THEN length({c}) - instr(reverse({c}), '{one}') ELSE -1 END)"


def _title(c):
    a = f"trim(regexp_replace({c}, '^\\[.*?\\]\\s*', ''))"
    b = f"trim(regexp_replace({a}, '\\s*\\|\\s*.*$', ''))"
    t = f"trim(regexp_replace({b}, '^[\\p{{L}}\\p{{N}}_]+:\\s*', ''))"
    for names in tx.SITES:
        t = f"(CASE WHEN length({t}) > 40 THEN trim(regexp_replace({t}, '(?i)\\s*-\\s*({names}).*$', '')) ELSE {t} END)"
    return f"CASE WHEN {t} = '' THEN {c} ELSE {t} END"


TRACK = ", ".join(f"'{t}'" for t in tx.TRACKING)

NORMAL_URLS = f"""p AS (SELECT id, url, regexp_extract(url, '(#.*)$', 1) AS frag, regexp_replace(url, '#.*$', '') AS body FROM articles_raw),
q AS (SELECT *, regexp_extract(body, '\\?(.*)$', 1) AS query, regexp_extract(body, '^([^?]*)', 1) AS base FROM p),
r AS (SELECT *, array_to_string(list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND split_part(x, '=', 1) NOT IN ({TRACK})), lambda x: url_encode(url_decode(split_part(x, '=', 1))) || '=' || url_encode(url_decode(regexp_extract(x, '=(.*)$', 1)))), '&') AS rest FROM q),
nu AS (SELECT id, CASE WHEN query = '' THEN url ELSE base || CASE WHEN rest = '' THEN '' ELSE '?' || rest END || frag END AS url FROM r)"""

SQL = {
    "H5_clean_valid": f"SELECT id, coalesce(length(content) >= 10 AND length(regexp_replace(content, '{_SP}', '', 'g')) / length(content) >= 0.1 AND length(content) <= 6000, false) AS valid FROM articles_raw",
    "H7_sanitize_text": f"""SELECT id, {_collapse("regexp_replace(title, '" + tx.CONTROL + "', '', 'g')")} AS title, md5({_collapse("regexp_replace(content, '" + tx.CONTROL + "', '', 'g')")}) AS content_md5 FROM articles_raw""",
    "H9_clean_title": f"SELECT id, {_title('a')} AS framed, {_title('b')} AS dashed FROM (SELECT id, '[News] Report: ' || title || ' | Site' AS a, title || ' - Daily Post' AS b FROM articles_raw)",
    "H10_normalize_url": f"WITH {NORMAL_URLS} SELECT id, url FROM nu",
    "H11_validate_url": f"""
WITH u AS (SELECT id, CASE WHEN seq % 9 = 0 THEN 'ftp://' || substr(url, 9) WHEN seq % 10 = 0 THEN upper(url) WHEN seq % 8 = 0 THEN 'http://localhost/x' ELSE url END AS u FROM articles_raw),
p AS (SELECT *, CASE WHEN lower(regexp_extract(u, '^([A-Za-z]+):', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches(lower(u), '{tx.SUSPICIOUS_URL}') THEN 'suspicious' END AS problem FROM u)
SELECT id, problem, CASE WHEN problem IS NULL THEN lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_extract(regexp_replace(u, '#.*$', ''), '^[A-Za-z]+://[^/?]+(.*)$', 1) END AS url FROM p""",
    "H12_likely_feed_url": f"SELECT url, regexp_matches(lower(url), '{tx.FEED_URL}') AS likely FROM (SELECT url FROM articles_raw UNION ALL SELECT url FROM feeds)",
    "H13_truncate_text": f"""SELECT id, CASE WHEN length(title) <= 60 THEN title WHEN {_last("substr(title, 1, 57)", " ")} > 30 THEN substr(title, 1, {_last("substr(title, 1, 57)", " ")}) || '...' ELSE substr(title, 1, 57) || '...' END AS title FROM articles_raw""",
    "H14_content_preview": f"""
WITH t AS (SELECT id, {_collapse('content')} AS t FROM articles_raw), h AS (SELECT *, substr(t, 1, 200) AS h FROM t),
e AS (SELECT *, greatest({_last('h', '.')}, {_last('h', '!')}, {_last('h', '?')}) AS e FROM h)
SELECT id, CASE WHEN length(t) <= 200 THEN t WHEN e > 140 THEN substr(t, 1, e + 1) ELSE substr(t, 1, 197) || '...' END AS preview FROM e""",
    "H15_source_name": "SELECT id, upper(substr(l, 1, 1)) || lower(substr(l, 2)) AS source FROM (SELECT id, split_part(regexp_replace(regexp_extract(source_feed, 'https?://([^/]+)', 1), '^www\\.', ''), '.', 1) AS l FROM articles_raw)",
    "H16_extractive_summary": r"""
SELECT id, CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], '. ') || '.' ELSE title END AS summary
FROM (SELECT id, title, list_filter(list_transform(string_split(content, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM articles_raw)""",
    "H17_reading_time": r"""
SELECT source_feed, floor(greatest(1.0, sum(coalesce(least(len(regexp_extract_all(content, '\S+')), 300), 100) + len(regexp_extract_all(title, '\S+'))) / 200))::BIGINT AS minutes
FROM articles_raw GROUP BY source_feed""",
    "D1_content_hash": "SELECT id, sha256(title || '|' || url) AS content_hash FROM articles_raw",
    "D2_body_hash": "SELECT id, md5(coalesce(content, '')) AS body_hash FROM articles_raw",
}
SQL = {k: with_views(v) for k, v in SQL.items()}
