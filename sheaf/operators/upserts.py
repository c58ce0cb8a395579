"""Merges into stored tables that rewrite only what a batch touches.

The rules are those of ``dedup`` and ``digest``, applied to the touched buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheaf.operators import dedup, digest
from sheaf.sources.buckets import BucketTable


def insert_new(articles: BucketTable, batch: DataFrame, batch_id: int | None = None) -> list[int]:
    """Insert-or-ignore by URL; ``articles`` has the key url."""
    return articles.merge(batch, dedup.insert_new, batch_id)


def merge_scores(articles: BucketTable, scored: DataFrame, batch_id: int | None = None) -> list[int]:
    """Upsert of scores by URL; ``articles`` has the key url and the columns of scores."""
    return articles.merge(scored, dedup.merge_scores, batch_id)


def merge_results(results: BucketTable, new: DataFrame, batch_id: int | None = None) -> list[int]:
    """Upsert by article, channel and topic; ``delivered`` of a stored row is kept."""
    return results.merge(new, dedup.merge_results, batch_id)


def mark_delivered(results: BucketTable, sent: DataFrame, batch_id: int | None = None) -> list[int]:
    """Sets ``delivered`` of the keys of ``sent``."""
    return results.merge(sent, digest.mark_delivered, batch_id)


def id_index(spark, path: str, articles: DataFrame, buckets: int = 64) -> BucketTable:
    """id, url of articles, dealt by id: where the rows of an id lie in a table dealt by URL."""
    return BucketTable(spark, path, ["id"]).create(articles.select("id", "url").distinct(), buckets)


def replace_batch(articles: BucketTable, index: BucketTable, batch: DataFrame, batch_id: int | None = None) -> list[int]:
    """Insert or replace by id or URL. ``articles`` is dealt by URL; the buckets of rows that share
    only the id are found by ``index``, which is written first and may name rows that are gone."""
    index.merge(batch.select("id", "url").distinct(), lambda stored, new: stored.union(new).distinct())
    # the index's own buckets of these ids, and no other
    ids = batch.select("id").distinct()
    elsewhere = index.touched(ids).join(ids, "id", "left_semi")
    return articles.merge(batch, dedup.replace_batch, batch_id, also=elsewhere.select("url"))
