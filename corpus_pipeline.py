"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns doc_id, source and tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheaf.llm import bpe, mixing, ngram_join, recipes, toxicity
from sheaf.llm.shared import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; trained on labelled rows that are not held out."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts the one with the largest doc_id; of those without doc_id one, where no other has the text."""
    return recipes.without_copies(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle overlap the one with the smallest doc_id."""
    return ngram_join.one_per_group(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token ids of every row of the mix."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern, carry=["source"]).select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: The trained classifier has no SQL; tests hold the pipeline against plain Python stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
