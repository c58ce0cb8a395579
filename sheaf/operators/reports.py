"""Counts and rates over feeds, topics, channels, users, runs, providers, errors and retries.

All are one or a few aggregations; ratios are guarded against empty denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def n_rows() -> Column:
    return F.count(F.lit(1))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Per cent, ``empty`` where there is nothing to divide by."""
    return F.round(F.when(whole > 0, part / whole * 100).otherwise(F.lit(empty)), 6)


def feed_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_feed").agg(n_rows().alias("articles")).orderBy(F.desc("articles"), "source_feed")


def feed_stats(feeds: DataFrame) -> DataFrame:
    """Per channel and, with chat_id null, over all: feeds, active, with errors, average errors, last success."""
    return feeds.groupingSets([["chat_id"], []], "chat_id").agg(
        n_rows().alias("total"), F.count_if("active").alias("active"), F.count_if(F.col("error_count") > 0).alias("with_errors"),
        F.round(F.avg("error_count"), 6).alias("average_errors"), F.max("last_success_at").alias("last_success_at"), F.count_distinct("owner").alias("channels"))


def feed_health(feeds: DataFrame, articles: DataFrame, healthy_below: int = 5, disable_at: int = 10) -> DataFrame:
    """Per channel and, with chat_id null, over all: active, healthy, with errors, disabled, articles, health in %."""
    per = articles.groupBy(F.col("source_feed").alias("url")).agg(n_rows().alias("n"))
    f = feeds.join(per, "url", "left").groupingSets([["chat_id"], []], "chat_id")
    healthy = F.count_if(F.col("active") & (F.col("error_count") < healthy_below))
    return f.agg(
        F.count_if("active").alias("active"), healthy.alias("healthy"), F.count_if((F.col("error_count") > 0) & F.col("active")).alias("with_errors"), F.count_if(~F.col("active") | (F.col("error_count") >= disable_at)).alias("disabled"),
        F.coalesce(F.sum(F.when(F.col("active"), F.col("n"))), F.lit(0)).alias("articles"), ratio(healthy, F.count_if("active")).alias("health"))


def channel_feeds(feeds: DataFrame) -> DataFrame:
    """Per channel: healthy feeds, feeds with errors, average errors and the list of feeds."""
    line = F.concat_ws(" ", "url", F.col("error_count").cast("string"), F.when(F.col("active"), "active").otherwise("off"))
    return feeds.groupBy("chat_id").agg(
        F.count_if(F.col("active") & (F.col("error_count") == 0)).alias("healthy"), F.count_if(F.col("error_count") > 0).alias("with_errors"), F.round(F.avg("error_count"), 6).alias("average_errors"),
        F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("feeds"))


def keyword_numbers(topics: DataFrame, keywords: DataFrame) -> DataFrame:
    n = keywords.filter("kind = 'include'").groupBy("name").agg(n_rows().alias("n_keywords"))
    return topics.join(n, "name", "left").withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0)))


def topic_stats(topics: DataFrame, keywords: DataFrame, as_of: Column) -> DataFrame:
    """``topics`` carries last_match_at."""
    t = keyword_numbers(topics, keywords)
    return t.agg(n_rows().alias("total"), F.count_if("active").alias("active"), F.round(F.avg("confidence_threshold"), 6).alias("average_threshold"), F.round(F.avg("n_keywords"), 6).alias("average_keywords"),
                 F.max("n_keywords").alias("most_keywords"), F.count_if(F.col("last_match_at") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("matched_lately"))


def channel_topics(topics: DataFrame, keywords: DataFrame) -> DataFrame:
    return keyword_numbers(topics, keywords).groupBy("chat_id").agg(n_rows().alias("topics"), F.sum("n_keywords").alias("keywords"), F.round(F.avg("n_keywords"), 6).alias("average_keywords"))


CHAT_TYPES = ("private", "group", "supergroup", "channel")


def channel_stats(channels: DataFrame) -> DataFrame:
    by_type = [F.count_if(F.col("active") & (F.col("chat_type") == t)).alias(f"active_{t}") for t in CHAT_TYPES]
    return channels.agg(n_rows().alias("total"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"), *by_type)


def channel_status(channels: DataFrame, topics: DataFrame, feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Topics, feeds and articles of each channel; an article counts once however often its feed is listed."""
    t = topics.groupBy("chat_id").agg(n_rows().alias("topics"))
    f = feeds.groupBy("chat_id").agg(n_rows().alias("feeds"))
    per = articles.groupBy(F.col("source_feed").alias("url")).agg(n_rows().alias("n"))
    a = feeds.select("chat_id", "url").distinct().join(per, "url").groupBy("chat_id").agg(F.sum("n").alias("articles"))
    j = channels.select("chat_id").join(t, "chat_id", "left").join(f, "chat_id", "left").join(a, "chat_id", "left")
    return j.select("chat_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("topics", "feeds", "articles")])


def user_usage(topics: DataFrame, users: DataFrame, free_limit: int = 5) -> DataFrame:
    """Topics per user with names by channel; unknown users count as free, pro users have no limit."""
    per = topics.filter("active").groupBy("telegram_user_id", "chat_id").agg(n_rows().alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    g = per.groupBy("telegram_user_id").agg(F.sum("n").alias("topics"), F.array_join(F.array_sort(F.collect_list(F.concat("chat_id", F.lit(":"), "names"))), ";").alias("by_channel"))
    j = g.join(users, "telegram_user_id", "left")
    tier = F.coalesce("subscription_tier", F.lit("free"))
    return j.select("telegram_user_id", tier.alias("tier"), "topics", "by_channel", F.when(tier == "free", F.lit(free_limit)).alias("topic_limit"), ((tier == "pro") | (F.col("topics") < free_limit)).alias("can_add"))


def delivery_stats(channels: DataFrame, feeds: DataFrame, articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    per = articles.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy(F.col("source_feed").alias("url")).agg(n_rows().alias("n"))
    a = feeds.filter("active").join(per, "url").groupBy("chat_id").agg(F.sum("n").alias("articles"))
    return channels.join(a, "chat_id", "left").select("chat_id", F.coalesce("articles", F.lit(0)).alias("articles"), "last_delivery_at")


def run_status(channels: DataFrame, as_of: Column) -> DataFrame:
    """Deliveries of the last week, whether there was one today, the last one, and the rate, 100 or 0 by construction."""
    last = F.col("last_delivery_at")
    week = F.count_if(last >= as_of - F.expr("INTERVAL 7 DAYS"))
    return channels.agg(week.alias("deliveries"), (F.count_if(F.to_date(last) == F.to_date(as_of)) > 0).alias("today"), F.max(last).alias("last_success"), F.when(week > 0, 100.0).otherwise(0.0).alias("success_rate"),
                        F.when(F.count_if(F.to_date(last) == F.to_date(as_of)) > 0, "healthy").when(week > 0, "degraded").otherwise("unhealthy").alias("status"))


def funnel(channels: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Per channel the counts of each step and its rates.

    ``counts`` has tables with a row per chat_id: fetched, unique, passed (the pre-filter), ready
    (accepted results) with n; fetches with ok, all; calls with ok, all, seconds (how long the run
    took); results with relevant, all; deliveries with sent, failed. What is absent counts 0; where
    nothing was sent, delivery is at 100."""
    j = channels.select("chat_id")
    for name, df in counts.items():
        df = df.select("chat_id", *[F.col(c).alias(name if c == "n" else f"{name}_{c}") for c in df.columns if c != "chat_id"])
        j = j.join(df, "chat_id", "left")
    j = j.na.fill(0)
    per_second = F.round(F.when(F.col("calls_seconds") > 0, F.col("fetched") / F.col("calls_seconds")).otherwise(0.0), 6)
    return j.select(
        "chat_id", "fetched", "unique", "passed", "ready", ratio(F.col("fetches_ok"), F.col("fetches_all")).alias("feed_success"), ratio(F.col("fetched") - F.col("unique"), F.col("fetched")).alias("deduplication"),
        ratio(F.col("unique") - F.col("passed"), F.col("unique")).alias("prefilter_reduction"), ratio(F.col("fetched") - F.col("ready"), F.col("fetched")).alias("overall_reduction"), per_second.alias("articles_per_second"),
        ratio(F.col("calls_ok"), F.col("calls_all")).alias("model_success"), ratio(F.col("results_relevant"), F.col("results_all")).alias("relevance"),
        ratio(F.col("deliveries_sent") - F.col("deliveries_failed"), F.col("deliveries_sent"), 100.0).alias("delivery_success"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """Totals per run and channel, per run, and over all. runs: run, chat_id, articles, messages, ok."""
    return runs.rollup("run", "chat_id").agg(
        F.sum("articles").alias("articles"), F.sum("messages").alias("messages"), F.round(F.when(F.sum("messages") > 0, F.sum("articles") / F.sum("messages")).otherwise(0.0), 6).alias("articles_per_message"),
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), ratio(F.count_if("ok"), n_rows()).alias("success_rate"))


def provider_breakdown(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(n_rows().alias("requests"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), ratio(F.count_if("success"), n_rows()).alias("success_rate"))


def error_stats(errors: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Errors of the last hours by category, severity and component, and over all, with recovery rates."""
    e = errors.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    g = e.groupingSets([["category"], ["severity"], ["component"], []], "category", "severity", "component").agg(
        n_rows().alias("errors"), ratio(F.count_if("recovery_successful"), F.count_if("recovery_attempted")).alias("recovery_rate"))
    kind = F.when(F.col("category").isNotNull(), "category").when(F.col("severity").isNotNull(), "severity").when(F.col("component").isNotNull(), "component").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("category", "severity", "component").alias("value"), "errors", "recovery_rate")


def recent_errors(errors: DataFrame, n: int, severity: str | None = None) -> DataFrame:
    """The last n errors; of one severity, those among the last 2 n."""
    if severity is None:
        return errors.orderBy(F.desc("ts"), F.desc("seq")).limit(n)
    return errors.orderBy(F.desc("ts"), F.desc("seq")).limit(2 * n).filter(F.col("severity") == severity).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def retry_stats(attempts: DataFrame, as_of: Column, hours: int = 24 * 30) -> DataFrame:
    """Per day and, with day null, over all: attempts, success rate, average delay."""
    a = attempts.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return a.rollup("day").agg(n_rows().alias("attempts"), ratio(F.count_if("success"), n_rows()).alias("success_rate"), F.round(F.avg("delay"), 6).alias("average_delay"))


def setup_audit(channels: DataFrame, feeds: DataFrame, topics: DataFrame, keywords: DataFrame) -> DataFrame:
    """What is wrong with each channel's setup, and whether it can work at all."""
    f = feeds.groupBy("chat_id").agg(n_rows().alias("n_feeds"), F.count_if(F.col("error_count") > 0).alias("bad"), F.count_if(F.col("error_count") >= 10).alias("dead"))
    t = keyword_numbers(topics, keywords).groupBy("chat_id").agg(n_rows().alias("n_topics"), F.count_if(F.col("n_keywords") < 2).alias("few"), F.count_if(F.col("confidence_threshold") < 0.35).alias("low"))
    j = channels.select("chat_id").join(f, "chat_id", "left").join(t, "chat_id", "left").na.fill(0)
    say = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
    issues = F.array_compact(F.array(F.when(F.col("n_feeds") == 0, F.lit("no feeds")), F.when(F.col("n_topics") == 0, F.lit("no topics")), say("few", "topics with few keywords"), say("low", "low thresholds"), say("bad", "feeds with errors"), say("dead", "feeds to disable")))
    return j.select("chat_id", F.array_join(issues, "; ").alias("issues"), ((F.col("n_feeds") > 0) & (F.col("n_topics") > 0)).alias("valid"))


def ingest_summary(fetches: DataFrame, items: DataFrame) -> DataFrame:
    """Per feed fetches that succeeded and failed and articles; with feed_id null over all. items: feed_id, n."""
    g = fetches.groupBy("feed_id").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"))
    j = g.join(items, "feed_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.rollup("feed_id").agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.sum("n").alias("articles"))
