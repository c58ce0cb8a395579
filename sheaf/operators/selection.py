"""Which articles, topics and channels a run works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions import text as tx
from sheaf.operators.automaton import hits as find


def unprocessed(articles: DataFrame, feeds: DataFrame, results: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """id, chat_id, created_at: articles of every channel's feeds, active or not, without any result for
    the channel, created within the last days."""
    recent = articles.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    pairs = recent.select("id", "source_feed", "created_at").join(feeds.select("chat_id", F.col("url").alias("source_feed")), "source_feed")
    done = results.select(F.col("article_id").alias("id"), "chat_id")
    return pairs.join(done, ["id", "chat_id"], "left_anti").select("id", "chat_id", "created_at")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key, with their rank; Spark keeps only k rows per task and key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def candidates(matched: DataFrame, k: int = 5) -> DataFrame:
    """Per channel and topic the newest matched articles; those without a date come last."""
    return top(matched, ["chat_id", "name"], [F.col("published_at").desc_nulls_last(), F.col("id")], k)


def deliverable(results: DataFrame, articles: DataFrame, topics: DataFrame, as_of: Column, k: int = 5, days: int = 1) -> DataFrame:
    """Per channel and topic the best undelivered results of the last days that reach the topic's
    threshold: by score, then date. Inactive topics deliver too."""
    new = results.filter(~F.col("delivered") & (F.col("processed_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    t = topics.select("chat_id", F.col("name").alias("topic_name"), "topic_ord", "confidence_threshold")
    j = new.join(t, ["chat_id", "topic_name"]).filter(F.col("confidence_score") >= F.col("confidence_threshold"))
    j = j.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return top(j, ["chat_id", "topic_name"], [F.desc("ai_relevance_score"), F.col("published_at").desc_nulls_last(), F.col("article_id")], k)


def preview(delivery: DataFrame, articles: DataFrame, shown: int = 2) -> DataFrame:
    """chat_id, topic_name, total, text: the first titles of each topic and how many more there are."""
    j = delivery.join(articles.select(F.col("id").alias("article_id"), tx.truncate(F.col("title"), 60).alias("t")), "article_id")
    g = j.groupBy("chat_id", "topic_name").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("rows"))
    more = F.when(F.col("total") > shown, F.concat(F.lit("\n... and "), F.col("total") - shown, F.lit(" more"))).otherwise("")
    return g.select("chat_id", "topic_name", "total", F.concat(F.array_join(F.transform(F.slice("rows", 1, shown), lambda r: r["t"]), "\n"), more).alias("text"))


def by_feed(articles: DataFrame, k: int) -> DataFrame:
    return top(articles, ["source_feed"], [F.desc("created_at"), F.col("seq")], k)


def recent(articles: DataFrame, as_of: Column, hours: int, n: int) -> DataFrame:
    return articles.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc("created_at"), "seq").limit(n)


def topics_of_users(topics: DataFrame, channels: DataFrame) -> DataFrame:
    """Active topics with their channel's title, by user; ``topics`` carries telegram_user_id."""
    return topics.filter("active AND telegram_user_id IS NOT NULL").join(channels.select("chat_id", "chat_title"), "chat_id").select("telegram_user_id", "chat_id", "chat_title", "name")


def search_topics(topics: DataFrame, keywords: DataFrame, queries: DataFrame) -> DataFrame:
    """query, chat_id, name: active topics of which the name or a keyword contains the query.

    All queries are looked up together in names and keywords; an empty one is part of every name, a
    null one of none."""
    names = topics.filter("active").select("name").distinct()
    words = keywords.filter("kind = 'include'").groupBy("name").agg(F.concat_ws(" | ", F.array_sort(F.collect_list("keyword"))).alias("words"))
    texts = names.join(words, "name", "left").select("name", F.lower("name").alias("by_name"), F.lower("words").alias("by_words"))
    asked = queries.select("query", F.lower("query").alias("term")).distinct()
    terms = asked.select(F.explode(F.array(F.lit("by_name"), F.lit("by_words"))).alias("surface"), "term")
    found = find(texts, terms).select(F.col("id").alias("name"), "term").distinct().join(asked, "term").select("query", "name")
    every = names.filter("name IS NOT NULL").crossJoin(F.broadcast(asked.filter("term = ''").select("query").limit(1)))  # one row
    return topics.filter("active").join(found.unionByName(every.select("query", "name")), "name").select("query", "chat_id", "name")


def owners(topics: DataFrame, channels: DataFrame) -> DataFrame:
    """chat_id, name, owner, outcome of unowned active topics: a private channel with a positive id
    owns its topics, all others are orphaned."""
    number = F.col("chat_id").try_cast("bigint")
    j = topics.filter("active AND telegram_user_id IS NULL").join(channels.select("chat_id", "chat_type"), "chat_id", "left")
    own = (F.col("chat_type") == "private") & (number > 0)
    return j.select("chat_id", "name", F.when(own, number).alias("owner"), F.when(own, "assigned").otherwise("orphaned").alias("outcome"))


def missing_users(owned: DataFrame, users: DataFrame) -> DataFrame:
    return owned.filter("owner IS NOT NULL").select(F.col("owner").alias("telegram_user_id")).distinct().join(users, "telegram_user_id", "left_anti")


def channels_due(feeds: DataFrame) -> DataFrame:
    return feeds.filter("active").select("chat_id").distinct()
