"""What is dropped with age, by cascade or by rule, and reports of rows that break rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import text as tx


def old_results(results: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Results that stay."""
    return results.filter(F.col("processed_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def old_articles(articles: DataFrame, results_left: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Articles that stay: young ones and those that a remaining result refers to."""
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    used = results_left.select(F.col("article_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return articles.join(used, "id", "left").filter((F.col("created_at") >= cut) | F.col("_used")).select(*articles.columns)


def simple_retention(results: DataFrame, articles: DataFrame, as_of: Column, days: int) -> DataFrame:
    """table, kept, dropped by age alone."""
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    one = lambda df, name, c: df.agg(F.lit(name).alias("table"), F.count_if(F.col(c) >= cut).alias("kept"), F.count_if(F.col(c) < cut).alias("dropped"))
    return one(results, "results", "processed_at").union(one(articles, "articles", "created_at"))


def cascade(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the channels in ``gone`` (chat_id)."""
    return {name: df.join(gone.select("chat_id"), "chat_id", "left_anti") for name, df in tables.items()}


def resolved_errors(errors: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Errors that stay: open ones and those resolved lately."""
    return errors.filter(F.col("resolved_at").isNull() | (F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))


def keyword(c: Column) -> Column:
    """A keyword in lower case without punctuation other than hyphens, of at most 100 characters."""
    return F.substring(F.lower(tx.collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-]", ""))), 1, 100)


def keyword_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, keyword), lambda k: k != ""))


def row_rules(articles: DataFrame, most_content: int = 50_000, most_title: int = 1000) -> DataFrame:
    """Articles with overlong content and titles cut, and a hash where none is given."""
    n = F.length("content")
    content = F.when(n > most_content, F.concat(F.substring("content", 1, most_content), F.lit("... [truncated]"))).otherwise(F.col("content"))
    return articles.withColumn("content", content).withColumn("title", F.substring("title", 1, most_title)).withColumn("content_hash", tx.content_hash(F.col("title"), F.col("url")))


def article_violations(articles: DataFrame) -> Column:
    """Codes of the rules that an article row breaks."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("title_required")), F.when(F.length("title") > 1000, F.lit("title_long")),
        F.when(tx.url_problem(F.col("url")).isNotNull(), F.concat(F.lit("url_"), tx.url_problem(F.col("url")))), F.when(F.length("content") > 50_000, F.lit("content_long")),
        F.when(F.length("content") < 50, F.lit("content_short"))))


def topic_violations() -> Column:
    words = F.regexp_count(F.col("name"), F.lit(r"\S+"))
    return F.array_compact(F.array(
        F.when(F.col("name").rlike(r"[<>\"'\\\n\r\t]"), F.lit("name_characters")), F.when(F.length("name") > 200, F.lit("name_long")), F.when((words < 5) | (words > 20), F.lit("name_words")),
        F.when(~F.col("confidence_threshold").between(0.0, 1.0), F.lit("threshold_range")), F.when(~F.col("chat_id").rlike(r"^-?\d+$"), F.lit("chat_id_format"))))


def repeated_keys(df: DataFrame, key: list[str], name: str, code: str) -> DataFrame:
    """table, key, code for keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("table"), F.concat_ws("|", *key).alias("key"), F.lit(code).alias("code"))


def orphans(df: DataFrame, column: str, parents: DataFrame, parent: str, name: str, code: str) -> DataFrame:
    p = parents.select(F.col(parent).alias(column)).distinct()
    return df.join(p, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.col(column).cast("string").alias("key"), F.lit(code).alias("code"))


def violations(articles: DataFrame, topics: DataFrame, results: DataFrame, channels: DataFrame) -> DataFrame:
    """table, key, code of every broken rule."""
    a = articles.select(F.lit("articles").alias("table"), F.col("id").alias("key"), F.explode(article_violations(articles)).alias("code"))
    t = topics.select(F.lit("topics").alias("table"), F.concat_ws("|", "chat_id", "name").alias("key"), F.explode(topic_violations()).alias("code"))
    return a.union(t).union(repeated_keys(articles, ["url"], "articles", "url_unique")).union(orphans(results, "article_id", articles, "id", "results", "article_missing")).union(orphans(results, "chat_id", channels, "chat_id", "results", "channel_missing"))


def split_rows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed items that can be used, and rejects with the reason."""
    link = F.coalesce(F.trim("link"), F.lit(""))
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(link == "", "no link").when(tx.url_problem(F.col("link")).isNotNull(), F.concat(F.lit("invalid url: "), tx.url_problem(F.col("link"))))
    r = items.withColumn("reason", reason)
    return r.filter("reason IS NULL").drop("reason"), r.filter("reason IS NOT NULL")
