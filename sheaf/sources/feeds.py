"""Feed documents as rows: items and metadata of RSS and Atom payloads, dates, contents, and the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheaf.functions import text as tx

_ITEM = "struct<title: string, link: string, description: string, encoded: string, summary: string, pubDate: string, updated: string, author: string, creator: string, category: array<string>, guid: string, enclosure: array<struct<_url: string, _type: string, _length: string>>>"
RSS = f"channel struct<title: string, link: string, description: string, language: string, lastBuildDate: string, generator: string, category: array<string>, image: struct<url: string, title: string>, item: array<{_ITEM}>>"
_LINK = "array<struct<_href: string, _rel: string>>"
_ENTRY = f"struct<title: string, link: {_LINK}, summary: string, content: string, published: string, updated: string, author: struct<name: string>, category: array<struct<_term: string>>, id: string>"
ATOM = f"title string, subtitle string, link {_LINK}, updated string, generator string, logo string, entry array<{_ENTRY}>"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def parsed(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """feed_url (and the columns of ``keep``) with the parsed RSS and Atom documents; what a payload is not stays null."""
    rss = F.when(F.col("payload").rlike(r"(?s)<rss\b"), F.from_xml("payload", F.lit(RSS), _OPTIONS))
    atom = F.when(F.col("payload").rlike(r"(?s)<feed\b"), F.from_xml("payload", F.lit(ATOM), _OPTIONS))
    return payloads.select("feed_url", *keep, rss.alias("rss"), atom.alias("atom"))


def items(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per item or entry, in document order: feed_url, position, title, link, summary, content,
    description, published, updated, author, categories, guid, enclosures, and the columns of ``keep``."""
    p = parsed(payloads, keep)
    i = p.select("feed_url", *keep, F.posexplode("rss.channel.item").alias("position", "i")).select(
        "feed_url", *keep, "position", "i.title", "i.link", "i.summary", F.col("i.encoded").alias("content"), "i.description", F.col("i.pubDate").alias("published"), "i.updated",
        F.coalesce("i.author", "i.creator").alias("author"), F.coalesce("i.category", F.array().cast("array<string>")).alias("categories"), "i.guid",
        F.transform("i.enclosure", lambda e: F.struct(e["_url"].alias("url"), e["_type"].alias("type"), e["_length"].alias("length"))).alias("enclosures"))
    href = lambda c: F.coalesce(F.try_element_at(F.filter(c, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)), F.try_element_at(c, F.lit(1)))["_href"]
    a = p.select("feed_url", *keep, F.posexplode("atom.entry").alias("position", "i")).select(
        "feed_url", *keep, "position", "i.title", href(F.col("i.link")).alias("link"), "i.summary", "i.content", F.lit(None).cast("string").alias("description"), "i.published", "i.updated",
        F.col("i.author.name").alias("author"), F.coalesce(F.transform("i.category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("categories"), F.col("i.id").alias("guid"),
        F.lit(None).cast("array<struct<url: string, type: string, length: string>>").alias("enclosures"))
    return i.unionByName(a)


def file_parts(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """feed_url (the file), block, place, value: files cut behind each ``</tag>``.

    The text source cuts, so a large file is read by as many tasks as it has blocks, and a file
    needs no memory but for its longest element. Order within a file is that of block and place."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    return rows.select(F.col("_metadata.file_path").alias("feed_url"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def file_items(spark: SparkSession, path: str) -> DataFrame:
    """``items`` of RSS and Atom files, of any size and several documents to a file, with block and
    place in place of the position. Elements must end in ``</item>`` or ``</entry>`` as written here,
    and their texts must not hold these strings unescaped."""
    whole = []
    for tag, before, after in (("item", "<rss><channel>", "</channel></rss>"), ("entry", "<feed>", "</feed>")):
        element = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>.*$", 0)
        rows = file_parts(spark, path, tag).withColumn("element", element).filter("element <> ''")
        whole.append(rows.select("feed_url", "block", "place", F.concat(F.lit(before), "element", F.lit(f"</{tag}>{after}")).alias("payload")))
    return items(whole[0].union(whole[1]), keep=("block", "place")).drop("position")


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``metadata`` of RSS and Atom files: what stands before the first item or entry of each document."""
    heads = []
    for tag, root in (("item", "rss"), ("entry", "feed")):
        head = F.regexp_extract("value", rf"(?s)<{root}[\s>](?:(?!<{tag}[\s>]|</{root}>).)*+", 0)
        close = "</channel></rss>" if root == "rss" else "</feed>"
        heads.append(file_parts(spark, path, tag).withColumn("head", head).filter("head <> ''").select("feed_url", F.concat(F.regexp_replace("head", r"\s*</channel>\s*$", ""), F.lit(close)).alias("payload")))
    return metadata(heads[0].union(heads[1]))


def metadata(payloads: DataFrame) -> DataFrame:
    """feed_url, title, link, description, language, categories, image of each document."""
    p = parsed(payloads)
    c = lambda x: F.nullif(tx.sanitize(F.col(x)), F.lit(""))
    return p.select(
        "feed_url", F.coalesce(c("rss.channel.title"), c("atom.title"), F.lit("Untitled Feed")).alias("title"), F.coalesce(c("rss.channel.link"), F.try_element_at("atom.link", F.lit(1))["_href"], F.col("feed_url")).alias("link"),
        F.coalesce(c("rss.channel.description"), c("atom.subtitle"), F.lit("")).alias("description"), c("rss.channel.language").alias("language"),
        F.coalesce("rss.channel.category", F.array().cast("array<string>")).alias("categories"), F.coalesce(c("rss.channel.image.url"), c("atom.logo")).alias("image"))


def pick_content(content: Column, description: Column, summary: Column) -> Column:
    """The first usable of three."""
    return F.coalesce(*[F.nullif(tx.sanitize(c), F.lit("")) for c in (content, description, summary)])


def parse_date(text: Column) -> Column:
    """RFC 822 and ISO dates as UTC timestamps; the name of the weekday is dropped. Null if neither fits."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    t = F.regexp_replace(t, r"\b(GMT|UTC|UT|Z)$", "+0000")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def item_date(published: Column, updated: Column, created: Column | None = None) -> Column:
    return F.coalesce(*[parse_date(c) for c in (published, updated, created) if c is not None])


def age_cut(rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Rows published lately or without a date."""
    return rows.filter(F.col("published_at").isNull() | (F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def write_snapshot(rows: DataFrame, path: str, date_column: str) -> None:
    """Parquet by day. Only days that ``rows`` has are replaced, so that a run can be repeated."""
    day = rows.withColumn("day", F.coalesce(F.date_format(date_column, "yyyy-MM-dd"), F.lit("none")))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
