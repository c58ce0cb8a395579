"""Digest texts: items, messages, headers, previews, and marking what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import text as tx

#: Articles per topic of the four formats, and the length of their summaries.
FORMATS = {"compact": (3, 0), "detailed": (5, 200), "summary": (8, 0), "headlines": (10, 0)}
RULE = "-" * 20


def items(delivery: DataFrame, articles: DataFrame, as_of: Column, form: str = "detailed", title_length: int = 120) -> DataFrame:
    """chat_id, topic_name, rank, item: the text of each article up to the format's number per topic.

    ``delivery``: chat_id, topic_name, rank, article_id."""
    limit, summary = FORMATS[form]
    a = articles.select(F.col("id").alias("article_id"), "title", "content", "url", "source_feed", "published_at")
    j = delivery.filter(F.col("rank") <= limit).select("chat_id", "topic_name", "rank", "article_id").join(a, "article_id")
    title, number = tx.truncate(F.col("title"), title_length), F.col("rank").cast("string")
    today = F.to_date("published_at") == F.to_date(as_of)
    day = F.date_format("published_at", "MM/dd")
    if form == "headlines":
        item = F.concat(F.lit("> "), title, F.lit("\n"))
    elif form == "summary":
        item = F.concat(number, F.lit(". "), title, F.coalesce(F.concat(F.lit(" - "), day), F.lit("")), F.lit("\n"))
    else:
        when = F.when(today, F.concat(F.lit("Today "), F.date_format("published_at", "HH:mm"))).otherwise(F.date_format("published_at", "MM/dd HH:mm"))
        detailed = form == "detailed"
        text = tx.preview(F.col("content"), summary) if detailed else F.lit("")
        facts = F.concat_ws(" - ", when, tx.source_name(F.col("source_feed")) if detailed else F.lit(None).cast("string"))
        item = F.concat(number, F.lit(". "), title, F.lit("\n\n"), F.when(text != "", F.concat(text, F.lit("\n\n"))).otherwise(""), F.when(facts != "", F.concat(facts, F.lit("\n"))).otherwise(""),
                        F.lit("Read: "), "url", F.lit("\n\n" + (RULE + "\n\n" if detailed else "")))
    return j.select("chat_id", "topic_name", "rank", item.alias("item"))


def messages(item_rows: DataFrame, most: int = 4096) -> DataFrame:
    """chat_id, topic_name, message_no, message: items packed in order, a new message where one would
    grow too long. Groups are bounded by the format's number of items."""
    g = item_rows.groupBy("chat_id", "topic_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda r: r["item"]).alias("items"))
    head = F.concat("topic_name", F.lit("\n\n"))
    again = F.concat("topic_name", F.lit(" (continued)\n\n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("now"))
    step = lambda acc, x: F.when(
        F.length(acc["now"]) + F.length(x) > most, F.struct(F.concat(acc["done"], F.array(F.rtrim(F.regexp_replace(acc["now"], r"\s+$", "")))).alias("done"), F.concat(again, x).alias("now"))
    ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], x).alias("now")))
    end = lambda acc: F.concat(acc["done"], F.array(F.regexp_replace(acc["now"], r"\s+$", "")))
    packed = g.select("chat_id", "topic_name", F.posexplode(F.aggregate("items", start, step, end)).alias("message_no", "message"))
    return packed.withColumn("message_no", F.col("message_no") + 1)


def headers(delivery: DataFrame) -> DataFrame:
    """chat_id, articles, topics, minutes, header of each channel's digest."""
    per = delivery.groupBy("chat_id", "topic_name").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("chat_id").agg(F.sum("n").alias("articles"), F.count(F.lit(1)).alias("topics"), F.array_sort(F.collect_list(F.concat("topic_name", F.lit(": "), "n", F.lit(" articles")))).alias("lines"))
    minutes = F.greatest(F.lit(1.0), F.col("articles") * 0.5)
    g = g.withColumn("minutes", minutes)
    text = F.concat(F.lit("Daily digest: "), "articles", F.lit(" articles from "), "topics", F.when(F.col("topics") == 1, " topic").otherwise(" topics"), F.lit(", "), F.ceil("minutes"), F.lit(" min\n"), F.array_join("lines", "\n"))
    return g.select("chat_id", "articles", "topics", "minutes", text.alias("header"))


def topic_preview(delivery: DataFrame, articles: DataFrame, limit: int = 3) -> DataFrame:
    """chat_id, topic_name, preview: the first titles with their dates."""
    a = articles.select(F.col("id").alias("article_id"), tx.truncate(F.col("title"), 70).alias("t"), F.date_format("published_at", "MM/dd").alias("day"))
    line = F.concat(F.col("rank"), F.lit(". "), "t", F.coalesce(F.concat(F.lit(" - "), "day"), F.lit("")))
    g = delivery.join(a, "article_id").groupBy("chat_id", "topic_name").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]).alias("lines"))
    more = F.when(F.col("n") > limit, F.concat(F.lit("\n... and "), F.col("n") - limit, F.lit(" more articles"))).otherwise("")
    return g.select("chat_id", "topic_name", F.concat("topic_name", F.lit(" preview\n"), F.array_join(F.slice("lines", 1, limit), "\n"), more).alias("preview"))


def mark_delivered(results: DataFrame, sent: DataFrame) -> DataFrame:
    """``results`` with delivered set for the keys of ``sent`` (article_id, chat_id, topic_name)."""
    key = ["article_id", "chat_id", "topic_name"]
    j = results.join(sent.select(*key).distinct().withColumn("_sent", F.lit(True)), key, "left")
    return j.withColumn("delivered", F.col("delivered") | F.coalesce("_sent", F.lit(False))).select(*results.columns)


def mark_channels(channels: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    s = sent.select("chat_id").distinct().withColumn("last_delivery_at", as_of)
    return channels.join(s, "chat_id", "left")
