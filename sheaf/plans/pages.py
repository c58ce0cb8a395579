"""Registered queries of feeds and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import html as op
from sheaf.sources import feeds as fd
from sheaf.sources.stage import shared_path
from sheaf.plans.text import NORMAL_URLS, _title
from sheaf.plans.views import now, view, with_views

A = lambda s, d: view(s, d, "articles_raw")
P = lambda s, d: view(s, d, "pages")


def payloads(s, d):
    """Feed documents made of the articles, twenty to a document, every other one Atom."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    a = A(s, d).withColumn("part", F.floor(F.col("seq") / 20))
    date, iso = F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = esc(F.col("content"))
    item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title>"), F.when(F.col("seq") % 19 == 0, "").otherwise(F.concat(F.lit("<link>"), esc(F.col("url")), F.lit("</link>"))), F.lit("<description>"), body, F.lit("</description>"),
                    F.when(F.col("published_at").isNull(), "").otherwise(F.concat(F.lit("<pubDate>Mon, "), date, F.lit(" GMT</pubDate>"))), F.lit("<category>a</category><category>b</category><guid>"), "id", F.lit("</guid></item>"))
    entry = F.concat(F.lit("<entry><title>"), esc(F.col("title")), F.lit('</title><link href="'), esc(F.col("url")), F.lit('"/><summary>'), body, F.lit("</summary>"), F.when(F.col("published_at").isNull(), "").otherwise(F.concat(F.lit("<published>"), iso, F.lit("Z</published>"))), F.lit("<id>"), "id", F.lit("</id></entry>"))
    g = a.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("x")))), lambda r: r["x"]), "").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("x")))), lambda r: r["x"]), "").alias("entries"))
    rss = F.concat(F.lit("<rss version='2.0'><channel><title>Feed "), "part", F.lit("</title><link>https://f.example.com/</link><description>d</description><language>en</language>"), "items", F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>Feed "), "part", F.lit("</title><subtitle>s</subtitle>"), "entries", F.lit("</feed>"))
    return g.select(F.concat(F.lit("https://f.example.com/"), "part").alias("feed_url"), F.when(F.col("part") % 2 == 0, rss).otherwise(atom).alias("payload"))


def s1(s, d):
    i = fd.items(payloads(s, d))
    return i.select("feed_url", "position", "title", "link", F.md5(F.coalesce("description", "summary")).alias("body_md5"), "published", F.array_join("categories", ",").alias("categories"), "guid")


def s1_files(s, d):
    """The same items from files that hold many documents, which are read in parts."""
    path = shared_path(s, "feeds")
    payloads(s, d).select("payload").write.text(path)
    i = fd.file_items(s, path)
    return i.select("title", "link", F.md5(F.coalesce("description", "summary")).alias("body_md5"), "published", F.array_join("categories", ",").alias("categories"), "guid")


def s2(s, d):
    return fd.metadata(payloads(s, d)).withColumn("categories", F.array_join("categories", ","))


def s3(s, d):
    a = A(s, d)
    return a.select("id", F.md5(fd.pick_content(F.when(F.col("seq") % 2 == 0, F.lit("  ")).otherwise(F.col("content")), F.when(F.col("seq") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("title")), F.col("url"))).alias("content_md5"))


def s4(s, d):
    stamp = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Tue, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return A(s, d).select("id", tx.stamp(fd.item_date(F.when(F.col("seq") % 7 == 0, "soon").otherwise(stamp), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))).alias("at"))


def s5(s, d):
    return fd.age_cut(A(s, d), now()).select("id")


def s7(s, d):
    path = shared_path(s, "snapshot")
    rows = A(s, d).select("id", "url", "published_at")
    fd.write_snapshot(rows, path, "published_at")
    fd.write_snapshot(rows.filter("published_at >= TIMESTAMP '2024-01-30'"), path, "published_at")
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def h1(s, d):
    return op.with_text(P(s, d))


def h2(s, d):
    return op.with_text(P(s, d), plain=True)


#: Images by page, which the generated pages lack: from the host, from elsewhere, inline, and one without a file.
PICTURES = """CASE page_id % 3 WHEN 0 THEN '<img src="/pics/' || page_id || '.png" alt="picture ' || page_id || '" width="640">' WHEN 1 THEN '<img alt="" title="far" src="https://cdn.example.com/x.jpg" height="48">' ELSE '' END
  || '<img src="data:image/png;base64,AA" alt="inline"><img alt="no file">' || CASE WHEN page_id % 5 = 0 THEN '<img src="//other.example.com/y.gif">' ELSE '' END"""


def h4(s, d):
    return op.images(P(s, d).withColumn("html", F.concat("html", F.expr(PICTURES))))


def h8(s, d):
    return op.normalized(A(s, d)).select("id", "title", "url", F.md5("content").alias("content_md5"), "content_hash")


QUERIES = {
    "S1_read_feed_items": s1, "S1_read_feed_files": s1_files, "S2_feed_metadata": s2, "S3_pick_content": s3, "S4_parse_dates": s4, "S5_age_cut": s5, "S6_page_articles": lambda s, d: op.page_articles(P(s, d)), "S7_snapshot_sink": s7,
    "H1_html_clean_text": h1, "H2_html_plain_text": h2, "H3_extract_links": lambda s, d: op.links(P(s, d)), "H4_extract_images": h4, "H6_page_metadata": lambda s, d: op.metadata(P(s, d)), "H8_normalize_article": h8,
}

_plain = lambda c: f"""replace(replace(replace(replace(replace(replace({c}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
_squeezed = lambda c: rf"trim(regexp_replace({c}, '{tx.SPACE}', ' ', 'g'))"
_without = r"""regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
TEXTS = f"tx AS MATERIALIZED (SELECT page_id, url, html, {_squeezed(_plain(_without))} AS text, len(regexp_extract_all(html, '<a\\b[^>]*>')) AS n_links FROM pages)"
_san = lambda c: rf"nullif(trim(regexp_replace(regexp_replace({c}, '{tx.CONTROL}', '', 'g'), '{tx.SPACE}', ' ', 'g')), '')"
SQL = {
    "S3_pick_content": f"""SELECT id, md5(coalesce({_san("CASE WHEN seq % 2 = 0 THEN '  ' ELSE content END")}, {_san("CASE WHEN seq % 3 = 0 THEN NULL ELSE title END")}, {_san("url")})) AS content_md5 FROM articles_raw""",
    "S4_parse_dates": """SELECT id, strftime(coalesce(CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 2 = 0 THEN published_at ELSE published_at - INTERVAL '2' HOUR END, created_at), '%Y-%m-%d %H:%M:%S') AS at FROM articles_raw""",
    "S5_age_cut": "SELECT id FROM articles_raw WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-24'",
    "S7_snapshot_sink": "SELECT coalesce(strftime(published_at, '%Y-%m-%d'), 'none') AS day, count(*) AS n FROM articles_raw GROUP BY 1",
    "H3_extract_links": r"""WITH l AS (SELECT page_id, url AS base, generate_subscripts(m, 1) - 1 AS position, unnest(m) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '<a\b[^>]*>.*?</a>') AS m FROM pages)),
      h AS (SELECT *, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM l)
      SELECT page_id, position::INT AS position, CASE WHEN href LIKE '/%' THEN regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1) || href ELSE href END AS url, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, '' AS title FROM h""",
    "H8_normalize_article": rf"""WITH {NORMAL_URLS}, ca AS (SELECT id, {_title(_squeezed(_plain('title')))} AS title, {_squeezed("regexp_replace(" + _plain('content') + ", '<[^>]+>', ' ', 'g')")} AS content FROM articles_raw)
      SELECT id, title, url, md5(CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || '...' ELSE content END) AS content_md5, sha256(title || '|' || url) AS content_hash FROM ca JOIN nu USING (id)""",
    # the generated pages have no dangerous element but scripts and styles, no form, and these character references
    "H1_html_clean_text": f"WITH {TEXTS} SELECT page_id, text FROM tx",
    "H2_html_plain_text": f"WITH {TEXTS} SELECT page_id, text FROM tx",
    "H6_page_metadata": f"WITH {TEXTS} SELECT page_id, text, len(regexp_extract_all(text, '\\S+')) AS word_count, n_links, 0 AS n_images, false AS has_media FROM tx",
    "S6_page_articles": rf"""WITH {TEXTS}, u AS (SELECT *, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_replace(url, '[?#].*$', '') AS base FROM tx),
      r AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.') AND split_part(x, '=', 1) NOT IN ({", ".join(f"'{t}'" for t in tx.TRACKING)})), '&') AS rest FROM u),
      v AS (SELECT *, lower(regexp_extract(base, '^([A-Za-z]+://[^/]+)', 1)) || regexp_replace(base, '^[A-Za-z]+://[^/]+', '') || CASE WHEN rest = '' THEN '' ELSE '?' || rest END AS clean,
        {_squeezed(_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title FROM r)
      SELECT page_id, title, clean AS url, text AS content, n_links, sha256(title || '|' || clean) AS content_hash FROM v""",
    "S1_read_feed_items": r"""WITH a AS (SELECT *, (seq // 20)::BIGINT AS part, row_number() OVER (PARTITION BY seq // 20 ORDER BY seq) - 1 AS position FROM articles_raw)
      SELECT 'https://f.example.com/' || part AS feed_url, position::INT AS position, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, CASE WHEN part % 2 = 1 OR seq % 19 <> 0 THEN url END AS link, md5(regexp_replace(content, '^\s+|\s+$', '', 'g')) AS body_md5,
        CASE WHEN part % 2 = 0 THEN 'Mon, ' || strftime(published_at, '%d %b %Y %H:%M:%S') || ' GMT' ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS published,
        CASE WHEN part % 2 = 0 THEN 'a,b' ELSE '' END AS categories, id AS guid FROM a""",
    "S2_feed_metadata": """WITH p AS (SELECT DISTINCT (seq // 20)::BIGINT AS part FROM articles_raw)
      SELECT 'https://f.example.com/' || part AS feed_url, 'Feed ' || part AS title, 'https://f.example.com/' || CASE WHEN part % 2 = 0 THEN '' ELSE part::VARCHAR END AS link, CASE WHEN part % 2 = 0 THEN 'd' ELSE 's' END AS description,
        CASE WHEN part % 2 = 0 THEN 'en' END AS language, '' AS categories, NULL::VARCHAR AS image FROM p""",
    "H4_extract_images": rf"""WITH p AS (SELECT page_id, url AS base, html || {PICTURES} AS html FROM pages),
      l AS (SELECT page_id, base, generate_subscripts(m, 1) - 1 AS position, unnest(m) AS tag FROM (SELECT page_id, base, regexp_extract_all(html, '<img\b[^>]*>') AS m FROM p)),
      a AS (SELECT *, regexp_extract(tag, ' src="([^"]*)"', 1) AS s FROM l)
      SELECT page_id, position::INT AS position, CASE WHEN s LIKE '//%' THEN regexp_extract(base, '^([A-Za-z]+):', 1) || ':' || s WHEN s LIKE '/%' THEN regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1) || s ELSE s END AS src,
        nullif(regexp_extract(tag, ' alt="([^"]*)"', 1), '') AS alt, nullif(regexp_extract(tag, ' title="([^"]*)"', 1), '') AS title, nullif(regexp_extract(tag, ' width="([^"]*)"', 1), '') AS width, nullif(regexp_extract(tag, ' height="([^"]*)"', 1), '') AS height
      FROM a WHERE s <> '' AND s NOT LIKE 'data:%'""",
}
SQL["S1_read_feed_files"] = f"SELECT title, link, body_md5, published, categories, guid FROM ({SQL['S1_read_feed_items']})"
SQL = {k: with_views(v) for k, v in SQL.items()}
