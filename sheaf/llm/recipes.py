"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: after at least ``least`` characters, at the next
sentence or line end, at ``most`` characters at the latest. Equal chunks get equal identifiers,
which are verified byte by byte once per distinct chunk; texts are then compared by their ordered
identifier lists, some bytes for each thousand of text, so long documents are not moved again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.llm.shared import staged, text_or_empty


def chunk_pattern(least: int, most: int) -> str:
    return rf"(?s).{{{least - 1},{most - 1}}}?[\n.!?]|.{{1,{most}}}"


def chunks(text: Column, least: int = 1024, most: int = 8192) -> Column:
    """The chunks of a text, in order; joined they are the text again. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def colliding_identifiers(texts: DataFrame, least: int, most: int, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Identifiers that two or more different chunks share. Empty unless a 64-bit hash collides.

    Distinct chunks are compared as bytes (they are the grouping key), each moved once a task."""
    return (
        texts.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
        .select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("id")
    )


def exact_groups(docs: DataFrame, least: int = 1024, most: int = 8192, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text, and empty texts are equal to
    each other. The largest doc_id of a group is kept. A row without doc_id takes part in its
    group and is never kept, unless the group has no doc_id at all (keep_id is then null and kept
    false). Rows that repeat the kept doc_id with the same text are all marked kept. Other columns
    of ``docs`` are ignored; an empty table gives an empty table. ``identify`` makes identifiers of
    chunks; where it gives two different chunks the same one, the texts that hold it are compared
    as such.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    shared_ids = staged(colliding_identifiers(texts, least, most, identify), "collisions")
    recipe = F.transform(chunks(F.col("text"), least, most), lambda c: identify(c))
    rows = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe"), "text")
    if shared_ids.isEmpty():
        rows = rows.withColumn("proof", F.lit(None).cast("string"))
    else:  # recipes with an unproven identifier have the text as part of the key
        unproven = rows.select("recipe").distinct().select("recipe", F.explode("recipe").alias("id")).join(shared_ids, "id", "left_semi").select("recipe").distinct()
        rows = rows.join(unproven.withColumn("unproven", F.lit(True)), "recipe", "left").withColumn("proof", F.expr("CASE WHEN unproven THEN text END"))
    rows = rows.select("doc_id", "text_sha256", "recipe", F.coalesce("proof", F.lit("")).alias("proof"))
    groups = rows.groupBy("recipe", "proof").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The further key makes both sides be exchanged for the join, so that AQE can split a hot group.
    spot = F.xxhash64("recipe", "proof").alias("spot")
    joined = rows.select("*", spot).join(groups.select("*", spot), ["spot", "recipe", "proof"])
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of equal texts those with the largest doc_id.

    A row goes by its own text, also where its doc_id stands on a row with another one. Of rows
    without doc_id one of each text stays, and none where a row with a doc_id has that text; rows
    that repeat the kept doc_id and text all stay."""
    groups = staged(exact_groups(docs, **options), "exact-groups")
    sha = F.sha2(text_or_empty(), 256)
    gone = groups.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    stay = docs.filter("doc_id IS NOT NULL").join(gone, (F.col("doc_id") == F.col("_gone")) & (sha == F.col("_gone_sha")), "left_anti")
    nameless = groups.filter("doc_id IS NULL AND keep_id IS NULL").select(F.col("text_sha256").alias("_sha")).distinct()
    alone = docs.filter("doc_id IS NULL").withColumn("_sha", sha).join(nameless, "_sha", "left_semi")
    first = alone.groupBy("_sha").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return stay.unionByName(first)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
