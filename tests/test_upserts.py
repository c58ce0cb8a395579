"""Merges into bucketed tables give what the operators give on whole tables, and leave other buckets alone."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import dedup, digest, upserts
from sheaf.sources.buckets import BucketTable

ARTICLES = "id string, title string, url string, seq long"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([(str(i), f"title {i}", f"u{i}", i) for i in range(200)] + [("x", "no url", None, 900), ("y", None, None, 901)], ARTICLES)


def test_insert_new(spark, stored, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", ["url"]).create(stored, 16)
    assert rows(t.read()) == rows(stored)
    batch = spark.createDataFrame([("a", "new", "u500", 1), ("b", "later", "u500", 2), ("c", "known", "u7", 3)], ARTICLES)
    before = t.folders()
    changed = upserts.insert_new(t, batch, batch_id=0)
    assert rows(t.read()) == rows(dedup.insert_new(stored, batch)) and len(changed) == 1
    after = t.folders()
    assert [b for b in after if before.get(b) != after[b]] == changed  # the bucket of u7 comes out as it was
    assert upserts.insert_new(t, batch, batch_id=0) == [] and t.folders() == after
    assert upserts.insert_new(t, batch) == [] and t.folders() == after  # without its number it is merged again and changes nothing


def test_replace_by_id_or_url(spark, stored, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", ["url"]).create(stored, 32)
    index = upserts.id_index(spark, f"{tmp_path}/i", stored, 8)
    first = spark.createDataFrame([("3", "same id", "u600", 1), ("z", "same url", "u9", 2), ("new", "new", "u601", 3), ("new", "newer", "u602", 4)], ARTICLES)
    second = spark.createDataFrame([("3", "again", "u603", 1), ("z", "again", "u3", 2)], ARTICLES)
    changed = upserts.replace_batch(t, index, first)
    whole = dedup.replace_batch(stored, first)
    assert rows(t.read()) == rows(whole) and 0 < len(changed) <= 6
    upserts.replace_batch(t, index, second)
    assert rows(t.read()) == rows(dedup.replace_batch(whole, second))
    assert not [r for r in t.read().collect() if r["url"] in ("u3", "u600") and r["id"] == "3"]


def test_scores_results_and_deliveries(spark, stored, tmp_path):
    s = stored.filter("url IS NOT NULL").withColumn("ai_relevance_score", F.lit(0.1)).withColumn("ai_confidence", F.lit(None).cast("double"))
    t = BucketTable(spark, f"{tmp_path}/s", ["url"]).create(s, 16)
    new = spark.createDataFrame([("q", "ignored", "u5", 1, 0.9, 0.5), ("r", "kept", "u700", 2, 0.8, 0.4)], ARTICLES + ", ai_relevance_score double, ai_confidence double")
    assert 0 < len(upserts.merge_scores(t, new)) <= 2
    assert rows(t.read()) == rows(dedup.merge_scores(s, new))
    schema = "article_id string, chat_id string, topic_name string, ai_relevance_score double, delivered boolean"
    r = spark.createDataFrame([(str(i), str(i % 3), "t", 0.5, i % 2 == 0) for i in range(100)], schema)
    results = BucketTable(spark, f"{tmp_path}/r", dedup.RESULT_KEY).create(r, 16)
    more = spark.createDataFrame([("4", "1", "t", 0.7, False), ("500", "1", "t", 0.2, True)], schema)
    upserts.merge_results(results, more)
    whole = dedup.merge_results(r, more)
    assert rows(results.read()) == rows(whole)
    sent = spark.createDataFrame([("1", "1", "t"), ("4", "1", "t"), ("none", "1", "t")], "article_id string, chat_id string, topic_name string")
    assert len(upserts.mark_delivered(results, sent)) == 1  # 4 is delivered already
    assert rows(results.read()) == rows(digest.mark_delivered(whole, sent))


def test_broken_merge_and_vacuum(spark, stored, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", ["url"]).create(stored, 8)
    batch = spark.createDataFrame([("a", "new", "u500", 1)], ARTICLES)

    def broken(old, new):
        t._write(dedup.insert_new(old, new), 1, 8)  # files of the next version are there, its commit is not
        raise OSError("lost")

    with pytest.raises(OSError):
        t.merge(batch, broken)
    assert rows(t.read()) == rows(stored)
    upserts.insert_new(t, batch)
    expected = rows(dedup.insert_new(stored, batch))
    assert rows(t.read()) == expected
    t.vacuum()
    assert rows(t.read()) == expected and len(t.files.names(f"{tmp_path}/t/commits")) == 1
    assert len(t.files.names(f"{tmp_path}/t/data")) == 2


def test_bucket_that_empties(spark, stored, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", ["url"]).create(stored, 8)
    gone = stored.filter("url = 'u1'")
    t.merge(gone, lambda old, new: old.limit(0))
    assert t.read().count() < stored.count() and t.read().filter("url = 'u1'").count() == 0
    empty = BucketTable(spark, f"{tmp_path}/e", ["url"]).create(stored.limit(0), 8)
    assert empty.read().count() == 0 and upserts.insert_new(empty, gone) and empty.read().count() == 1
