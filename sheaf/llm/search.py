"""Ranked lexical search by range-maximum tables over posting lists.

Documents are indexed in blocks of so many postings. In a block each term has a posting list in
document order, with the share of the score that it gives each document, and a sparse table that
tells the largest share in any stretch of the list. A search holds intervals of documents, each with
the sum over its terms of these maxima; it takes those of highest bound first, scores the document
where the largest maximum stands, and goes on with the intervals on both sides of it, until no bound
reaches the best ``k`` scores found. All numbers of a score are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheaf.llm.shared import staged

#: Bytes that are no letters, digits or parts of further characters are space; A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Documents without id stand behind the others.
NO_ID = np.iinfo(np.int64).max
#: Intervals of highest bound that are split in one step.
STEP = 256


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: distinct terms (binary) of each item; rows of one item_id are one item."""
    kind = items.schema["item_id"].dataType

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [list(set(terms_of(t))) for t in b.column(1).to_pylist()]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    schema = T.StructType([T.StructField("item_id", kind), T.StructField("term", T.BinaryType())])
    return items.select("item_id", "text").mapInArrow(batches, schema).distinct()


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs of documents with a term: how many terms, which of the vocabulary (numbers) and how often.

    ``vocabulary`` is a broadcast dict of term to number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in it:
            ids, n, terms, tfs = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms_of(text.as_py())
                if found:
                    here = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    ids.append(doc_id)
                    n.append(len(found))
                    terms.append([t for t, _ in here])
                    tfs.append([c for _, c in here])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, n long, terms array<int>, tfs array<long>")


class Index:
    """Posting lists of one block, term by term in document order, and their range-maximum tables."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        # Documents with the same most frequent term stand together, so that whole intervals lack the terms of another language.
        first = np.zeros(len(ids), np.int64)
        by_tf = np.argsort(tf, kind="stable")
        first[doc[by_tf]] = term[by_tf]
        order = np.lexsort((n, first))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, m = ids[order], (50 + (50 * n * n_docs) // n_terms)
        share = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        keep = share > 0
        term, doc, share = term[keep], place[doc[keep]], share[keep]
        order = np.lexsort((doc, term))
        self.share, self.doc = share[order], doc[order]
        term = term[order]
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.key = term * len(ids) + self.doc
        longest = int(np.diff(self.start).max(initial=0))
        table, step = [np.arange(len(self.share), dtype=np.int32)], 1
        while 2 * step <= longest:
            a, b = table[-1][:-step], table[-1][step:]
            table.append(np.concatenate([np.where(self.share[b] > self.share[a], b, a), table[-1][-step:]]))
            step *= 2
        self.table, self.size = np.concatenate(table), len(self.share)
        self.log = np.zeros(longest + 1, np.int64)
        for j in range(1, len(table)):
            self.log[1 << j :] = j

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the largest shares between ``lo`` and ``hi`` (excluded) of posting lists; 0 where nothing is between."""
        some = hi > lo
        j = self.log[np.where(some, hi - lo, 0)]
        a = self.table[j * self.size + np.where(some, lo, 0)]
        b = self.table[j * self.size + np.where(some, hi - (1 << j), 0)]
        at = np.where(self.share[b] > self.share[a], b, a)
        return at, np.where(some, self.share[at], 0)

    def search(self, terms: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``k`` scores above 0 and their ids, of this block and of ``scores`` and ``ids``, which hold the best so far."""
        terms = terms[self.start[terms + 1] > self.start[terms]]
        if not len(terms):
            return scores, ids
        lo, hi = self.start[terms][None, :], self.start[terms + 1][None, :]
        base = terms * len(self.ids)
        at, values = self.largest(lo, hi)
        bound, where = values.sum(1), at[np.arange(1), values.argmax(1)]
        while len(bound):
            least = scores.min() if len(scores) == k else 1
            if len(bound) > STEP:
                top = np.argpartition(bound, len(bound) - STEP)[-STEP:]
                rest = np.ones(len(bound), bool)
                rest[top] = False
            else:
                top, rest = slice(None), np.zeros(len(bound), bool)
            split, a, z = self.doc[where[top]], lo[top], hi[top]
            place = np.searchsorted(self.key, base + split[:, None])
            hit = (place < z) & (self.doc[np.minimum(place, self.size - 1)] == split[:, None])
            found = np.where(hit, self.share[np.minimum(place, self.size - 1)], 0).sum(1)
            good = found >= least
            if good.any():
                scores, ids = np.concatenate([scores, found[good]]), np.concatenate([ids, self.ids[split[good]]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                least = scores.min() if len(scores) == k else 1
            below, above = np.concatenate([a, place + hit]), np.concatenate([place, z])
            at, values = self.largest(below, above)
            sums = values.sum(1)
            go, stay = sums >= least, rest & (bound >= least)
            at, values = at[go], values[go]
            lo, hi = np.concatenate([lo[stay], below[go]]), np.concatenate([hi[stay], above[go]])
            where = np.concatenate([where[stay], at[np.arange(len(at)), values.argmax(1)]])
            bound = np.concatenate([bound[stay], sums[go]])
        return scores, ids


def _blocks(it: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    """Consecutive rows with at least so many postings, the last block with what is left."""
    held, size = [], 0
    for b in it:
        ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)) + size if b.num_rows else np.zeros(0)
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, postings)) + 1
            held.append(b.slice(at, to - at))
            if to > b.num_rows:
                break
            yield pa.Table.from_batches(held)
            held, ends, at = [], ends - ends[to - 1], to
        size = int(ends[-1]) if at < b.num_rows else 0
    if held:
        yield pa.Table.from_batches(held)


def _search_chunk(docs: DataFrame, asked: DataFrame, kind: T.DataType, k: int, block_postings: int) -> DataFrame:
    """item_id, doc_id, score: the best ``k`` of each task, for the items of ``asked`` (item_id, term), a bounded number."""
    spark = docs.sparkSession
    rows = asked.toPandas()
    rows["term"] = rows["term"].map(bytes)
    vocabulary = {t: i for i, t in enumerate(sorted(set(rows["term"])))}
    items = [(None if pd.isna(i) else i, np.array(sorted(vocabulary[t] for t in g["term"]), np.int64)) for i, g in rows.groupby("item_id", dropna=False, sort=True)]
    counts = staged(term_counts(docs, spark.sparkContext.broadcast(vocabulary)), "term-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = {r["term"]: r["df"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    shared = spark.sparkContext.broadcast((items, weight))
    out = pa.schema([("item_id", to_arrow_type(kind)), ("doc_id", pa.int64()), ("score", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for block in _blocks(it, block_postings):
            ids = block.column(0).combine_chunks().fill_null(int(NO_ID)).to_numpy()
            terms, tfs = block.column(2).combine_chunks(), block.column(3).combine_chunks()
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            index = Index(ids, block.column(1).to_numpy(), doc, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), weight, n_docs, n_terms)
            best = [index.search(asked, *b, k) if index.size else b for (_, asked), b in zip(items, best)]
        for (item, _), (scores, ids) in zip(items, best):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), out.field(0).type), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], schema=out)

    return counts.mapInArrow(batches, T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_postings: int = 2**19, chunk_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item.

    Equal scores go by ascending doc_id, documents without id last; rows that repeat a doc_id are
    documents of their own, rows of one item_id (null included) one item. Texts that are null or
    without terms count nowhere and find nothing. Other columns are ignored; an empty table on
    either side gives an empty table. Items are asked in chunks of about ``chunk_terms`` (item, term)
    pairs, which the driver holds; documents are read once a chunk and never moved: a task indexes
    its rows in blocks of ``block_postings`` postings and keeps ``k`` rows per item."""
    kind = items.schema["item_id"].dataType
    asked = staged(item_terms(items), "item-terms")
    chunks = max(1, math.ceil(asked.count() / chunk_terms))
    found = None
    for c in range(chunks):
        part = _search_chunk(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c), kind, k, block_postings)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
f AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
FROM f WHERE score > 0 QUALIFY rank <= 50
"""
