"""Duplicates within a batch and against history, and merges of article and result tables.

Rows carry ``seq`` in place of list order. Every operator is a few aggregates and equi-joins; texts
are not moved unless a result row needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.functions import text as tx


def quality(as_of: Column) -> Column:
    """Quality of an article by title, content, age and URL: weights .3, .5, .1, .1."""
    title_n, content_n = F.length("title"), F.length("content")
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600
    marks = F.length("url") - F.length(F.regexp_replace("url", "[&?]", ""))
    total = (
        F.when(title_n >= 10, 0.3 * F.least(title_n / 100, F.lit(1.0))).otherwise(0.0)
        + F.when(content_n >= 50, 0.5 * F.least(content_n / 1000, F.lit(1.0))).otherwise(0.0)
        + F.when(F.col("published_at").isNotNull(), 0.1 * F.greatest(F.lit(0.0), 1 - age / 168)).otherwise(0.0)
        + 0.1 * F.greatest(F.lit(0.5), 1 - 0.1 * marks)
    )
    return F.least(total, F.lit(1.0))


def _first_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the least seq with the same key; null where the key is. A further key of the join, computed
    after the grouping, has both sides exchanged, so that AQE can split a hot key; rows without key
    are spread by their seq."""
    spot = F.when(F.col(key).isNull(), F.xxhash64("seq")).otherwise(F.xxhash64(key)).alias("_spot")
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias(name))
    return df.select("*", spot).join(first.select(key, name, F.xxhash64(key).alias("_spot")), ["_spot", key], "left").drop("_spot")


def batch_duplicates(articles: DataFrame, least_title: int = 10, least_content: int = 50) -> DataFrame:
    """seq, content_hash, url, is_duplicate, duplicate_of, issues: a row is a duplicate if an earlier one
    has its hash or its URL; the URL is named if both do. A null URL is equal to none, and so is the hash
    of a null title or URL: such rows stay, with a null hash."""
    keys = articles.select("seq", "url", tx.content_hash(F.col("title"), F.col("url")).alias("content_hash"), F.length("title").alias("tn"), F.length("content").alias("cn"))
    d = _first_of(_first_of(keys, "content_hash", "h0"), "url", "u0")
    by_hash, by_url = (F.coalesce(F.col("seq") > F.col(c), F.lit(False)) for c in ("h0", "u0"))
    issues = F.array_compact(F.array(
        F.when(by_hash, F.lit("Duplicate content hash")), F.when(by_url, F.lit("Duplicate URL")),
        F.when((F.col("tn") > 0) & (F.col("tn") < least_title), F.lit("Title too short")), F.when((F.col("cn") > 0) & (F.col("cn") < least_content), F.lit("Content too short"))))
    return d.select("seq", "content_hash", "url", (by_hash | by_url).alias("is_duplicate"), F.when(by_url, F.col("url")).when(by_hash, F.col("content_hash")).alias("duplicate_of"), issues.alias("issues"))


#: Keys of a batch whose hashes are broadcast, 8 bytes each, to leave out what it has not before history is moved.
BROADCAST_KEYS = 2_000_000


def with_keys_of(rows: DataFrame, key: Column, batch: DataFrame, batch_key: Column, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows whose key may be among the batch's keys: all that are, and those of equal 64-bit hash.

    The batch's distinct keys are counted; where there are more than ``most`` all rows stay, as a
    batch of that size is moved like the history itself."""
    hashes = batch.select(F.xxhash64(batch_key).alias("_h")).distinct()
    if hashes.limit(most + 1).count() > most:
        return rows
    return rows.withColumn("_k", F.xxhash64(key)).join(F.broadcast(hashes), F.col("_k") == F.col("_h"), "left_semi").drop("_k")


def history_duplicates(articles: DataFrame, history: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """seq, is_duplicate, duplicate_of, issues against articles created or published in the last days;
    of too old, known hash and known URL the last that holds is named. ``history`` has title and url,
    or content_hash and url; of its rows only those with a key of the batch are moved."""
    cutoff = as_of - F.expr(f"INTERVAL {days} DAYS")
    hash_of = tx.content_hash(F.col("title"), F.col("url"))
    known = history.filter((F.col("created_at") >= cutoff) | (F.col("published_at") >= cutoff)).select(F.col("content_hash") if "content_hash" in history.columns else hash_of.alias("content_hash"), "url")
    hashes = with_keys_of(known.select(F.col("content_hash").alias("kh")), F.col("kh"), articles, hash_of).distinct()
    urls = with_keys_of(known.select(F.col("url").alias("ku")), F.col("ku"), articles, F.col("url")).distinct()
    a = articles.select("seq", "url", "published_at", tx.content_hash(F.col("title"), F.col("url")).alias("content_hash"))
    j = a.join(hashes, F.col("content_hash") == F.col("kh"), "left").join(urls, F.col("url") == F.col("ku"), "left")
    old, day = F.coalesce(F.col("published_at") < cutoff, F.lit(False)), F.date_format("published_at", "yyyy-MM-dd")
    of = F.when(F.col("ku").isNotNull(), F.concat(F.lit("db_url:"), "url")).when(F.col("kh").isNotNull(), F.concat(F.lit("db_hash:"), "content_hash")).when(old, F.concat(F.lit("old_article:"), day))
    issues = F.array_compact(F.array(
        F.when(old, F.concat(F.lit("Article too old (published "), day, F.lit(")"))), F.when(F.col("kh").isNotNull(), F.lit("Duplicate in database (content)")),
        F.when(F.col("ku").isNotNull(), F.lit("Duplicate in database (URL)"))))
    return j.select("seq", of.isNotNull().alias("is_duplicate"), of.alias("duplicate_of"), issues.alias("issues"))


def merged_verdicts(batch: DataFrame, against_history: DataFrame) -> DataFrame:
    """The history's verdict where it says duplicate, else the batch's."""
    h = against_history.select("seq", F.col("is_duplicate").alias("hd"), F.col("duplicate_of").alias("ho"), F.col("issues").alias("hi"))
    pick = lambda a, b: F.when(F.col("hd"), F.col(a)).otherwise(F.col(b))
    return batch.join(h, "seq").select("seq", pick("hd", "is_duplicate").alias("is_duplicate"), pick("ho", "duplicate_of").alias("duplicate_of"), pick("hi", "issues").alias("issues"))


def dedup_stats(verdicts: DataFrame) -> DataFrame:
    said, dup = F.lower(F.array_join("issues", " ")), F.col("is_duplicate")
    n = lambda c: F.count_if(c)
    by_hash = dup & said.contains("content hash")
    by_url = dup & ~said.contains("content hash") & said.contains("url")
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_articles"), n(~dup).alias("unique_articles"), n(dup).alias("duplicates_found"), n(by_hash).alias("by_hash"),
        n(by_url).alias("by_url"), n(dup & ~by_hash & ~by_url).alias("by_content"),
        F.when(F.count(F.lit(1)) > 0, F.round(n(dup) / F.count(F.lit(1)) * 100, 6)).otherwise(0.0).alias("deduplication_rate"))


def issue_histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def dedup_summary(articles: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    q = articles.select("seq", quality(as_of).alias("q")).join(verdicts, "seq")
    dup = F.col("is_duplicate")
    return q.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(dup).alias("duplicates"), F.count_if(~dup).alias("unique"),
        F.round(F.when(F.count(F.lit(1)) > 0, F.count_if(dup) / F.count(F.lit(1)) * 100).otherwise(0.0), 6).alias("rate"),
        F.round(F.avg(F.when(~dup, F.col("q"))), 6).alias("average_quality"))


def unknown_hashes(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose hash is not stored; both sides have title and url. Of what is stored only rows with a hash of the batch are moved."""
    hash_of = tx.content_hash(F.col("title"), F.col("url"))
    hashes = with_keys_of(stored.select(hash_of.alias("content_hash")), F.col("content_hash"), articles, hash_of)
    return articles.withColumn("content_hash", hash_of).join(hashes, "content_hash", "left_anti")


def insert_new(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``stored`` and the first row per URL of ``batch`` whose URL it lacks."""
    first = batch.groupBy("url").agg(F.min("seq").alias("seq")).select("seq")
    new = batch.join(first, "seq", "left_semi").join(stored.select("url"), "url", "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def replace_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace by id or URL: the last row of a batch wins, and every stored row that shares
    id or URL with it goes. A batch row also goes if a later one has its id or its URL."""
    last_id = batch.groupBy("id").agg(F.max("seq").alias("by_id"))
    last_url = batch.groupBy("url").agg(F.max("seq").alias("by_url"))
    keep = batch.select("id", "url", "seq").join(last_id, "id").join(last_url, "url").filter("seq >= by_id AND seq >= by_url").select("seq")
    new = batch.join(keep, "seq", "left_semi")
    old = stored.join(batch.select("id"), "id", "left_anti").join(batch.select("url"), "url", "left_anti")
    return old.select(*stored.columns).unionByName(new.select(*stored.columns))


SCORES = ("ai_relevance_score", "ai_confidence")


def merge_scores(stored: DataFrame, scored: DataFrame, columns: tuple[str, ...] = SCORES) -> DataFrame:
    """Upsert by URL: a known URL keeps its id, title, content and dates and takes the new scores."""
    new = scored.select(*[F.col(c).alias(f"_{c}") for c in scored.columns])
    j = stored.join(new, F.col("url") == F.col("_url"), "full_outer")
    known = F.col("url").isNotNull()
    out = [
        F.when(F.col("_url").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c) if c in stored.columns else F.lit(None)).alias(c) if c in columns
        else F.when(known, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        for c in dict.fromkeys([*stored.columns, *columns])
    ]
    return j.select(*out)


RESULT_KEY = ["article_id", "chat_id", "topic_name"]


def latest(log: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last row per key; a max over a struct combines before the shuffle, so hot keys are harmless."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*key, "_row.*").select(*log.columns)


def merge_results(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by article, channel and topic; ``delivered`` of a stored row is kept, a new row's is false."""
    n = new.select(*RESULT_KEY, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in RESULT_KEY], F.lit(True).alias("_new"))
    j = stored.join(n, RESULT_KEY, "full_outer")
    rest = [c for c in stored.columns if c not in (*RESULT_KEY, "delivered")]
    return j.select(*RESULT_KEY, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest], F.coalesce("delivered", F.lit(False)).alias("delivered"))


def repeat_bonus(evaluations: DataFrame, order: list[Column]) -> DataFrame:
    """The 2nd and later evaluation of a body gets 0.05. ``evaluations`` has body_hash and the columns
    of ``order``, which is the order of evaluation over all channels and topics."""
    first = evaluations.groupBy("body_hash").agg(F.min(F.struct(*order)).alias("_first"))
    spot = F.xxhash64("body_hash").alias("_spot")
    j = evaluations.select("*", spot).join(first.select("body_hash", "_first", spot), ["_spot", "body_hash"])
    return j.withColumn("bonus", F.when(F.struct(*order) > F.col("_first"), F.lit(0.05)).otherwise(F.lit(0.0))).drop("_spot", "_first")
