"""Toxicity by a factorization machine over hashed terms.

A term is a word or the first letters of a longer word, hashed. The machine adds a weight per term
and, through a short vector per term, a weight per pair of terms, so that two terms which are
harmless apart can be toxic together. It is trained in numpy on a bounded sample of labelled rows
and applied to whole texts on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheaf.llm.shared import text_or_empty

#: Hash values of terms.
BITS = 18
#: Lengths of the word beginnings that count as terms of their own.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Numbers of terms that may learn and shares of terms left out, of which folds of the training rows decide.
SETTINGS, FOLDS = ((512, 0.3), (1024, 0.3)), 3
#: How many times as much as precision recall counts where the classes part.
BETA = 2.0
#: Distinct words whose terms a Python worker remembers; when full it starts afresh.
REMEMBERED = 200_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„‘’…–—"

_terms_of: dict[str, tuple[int, ...]] = {}


def word_terms(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES)
    if not word:
        return ()
    spelled = [word, *[f"{word[:n]}~" for n in BEGINNINGS if len(word) > n]]
    return tuple(zlib.crc32(s.encode()) >> (32 - BITS) for s in spelled)


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a whole text, ascending."""
    if len(_terms_of) > REMEMBERED:
        _terms_of.clear()
    found: set[int] = set()
    for word in set(text.lower().split()):
        known = _terms_of.get(word)
        if known is None:
            known = word_terms(word)
            if len(word) <= 40:
                _terms_of[word] = known
        found.update(known)
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Machine:
    """``slot`` maps a hashed term to its row of ``w`` and ``v``, or to the last row, which is zero.
    The margin is shifted to where the classes part best."""

    bias: float
    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray
    shift: float = 0.0

    def margin(self, term_lists: list[np.ndarray]) -> np.ndarray:
        rows, ends = _flat([self.slot[t] for t in term_lists], len(self.w) - 1)
        z = self.bias + np.add.reduceat(self.w[rows], ends)
        sums = np.add.reduceat(self.v[rows], ends, axis=0)
        squares = np.add.reduceat(self.v[rows] ** 2, ends, axis=0)
        return z + 0.5 * (sums**2 - squares).sum(axis=1)

    def score(self, term_lists: list[np.ndarray]) -> np.ndarray:
        return _logistic(self.margin(term_lists) + self.shift)


def _flat(lists: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all lists, each list closed by the zero row ``none``, and where each list begins."""
    sizes = np.array([len(x) + 1 for x in lists])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    rows = np.full(sizes.sum(), none, dtype=np.int64)
    for s, x in zip(starts, lists):
        rows[s : s + len(x)] = x
    return rows, starts


def train(term_lists: list[np.ndarray], labels: np.ndarray, keep: int = 1024, factors: int = 4, epochs: int = 20,
          batch: int = 128, rate: float = 0.03, decay: float = 1e-4, drop: float = 0.0, seed: int = 1) -> Machine:
    """Logistic loss with Adam over the ``keep`` terms that tell the classes apart best. Each time a
    text is shown a share ``drop`` of its terms is left out, so that one sign of many has to do."""
    n = len(term_lists)
    toxic = float(labels.sum())
    flat = np.concatenate([*term_lists, np.zeros(0, np.int32)])
    owner = np.repeat(labels, [len(x) for x in term_lists]) if n else np.zeros(0)
    size = 1 << BITS
    all_n, bad_n = np.bincount(flat, minlength=size), np.bincount(flat, weights=owner, minlength=size)
    rate_all = all_n / max(n, 1)
    spread = np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-9) * (1 / max(toxic, 1) + 1 / max(n - toxic, 1)))
    z = np.where(all_n >= 3, np.abs(bad_n / max(toxic, 1) - (all_n - bad_n) / max(n - toxic, 1)) / spread, 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:keep])
    slot = np.full(size, keep, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(keep + 1), rng.normal(0, 0.02, (keep + 1, factors))
    v[keep] = 0
    bias = np.log((toxic + 1) / (n - toxic + 1))
    lists = [s[s < keep] for s in (slot[x] for x in term_lists)]
    mw, uw, mv, uv, mb, ub, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            rows, starts = _flat([x[rng.random(len(x)) >= drop] for x in (lists[i] for i in pick)], keep)
            of = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(rows))))
            sums = np.add.reduceat(v[rows], starts, axis=0)
            zed = bias + np.add.reduceat(w[rows], starts) + 0.5 * (sums**2 - np.add.reduceat(v[rows] ** 2, starts, axis=0)).sum(axis=1)
            g = (_logistic(zed) - labels[pick]) / len(pick)
            gw = np.bincount(rows, weights=g[of], minlength=keep + 1) + decay * w
            each = g[of][:, None] * (sums[of] - v[rows])
            gv = np.stack([np.bincount(rows, weights=each[:, f], minlength=keep + 1) for f in range(factors)], axis=1) + decay * v
            gb = g.sum()
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            mw, uw = 0.9 * mw + 0.1 * gw, 0.999 * uw + 0.001 * gw**2
            mv, uv = 0.9 * mv + 0.1 * gv, 0.999 * uv + 0.001 * gv**2
            mb, ub = 0.9 * mb + 0.1 * gb, 0.999 * ub + 0.001 * gb**2
            w -= rate * (mw / fix1) / (np.sqrt(uw / fix2) + 1e-8)
            v -= rate * (mv / fix1) / (np.sqrt(uv / fix2) + 1e-8)
            bias -= rate * (mb / fix1) / (np.sqrt(ub / fix2) + 1e-8)
            w[keep], v[keep] = 0, 0
    return Machine(float(bias), slot, w.astype(np.float32), v.astype(np.float32))


def best_cut(margin: np.ndarray, labels: np.ndarray, beta: float = BETA) -> tuple[float, float]:
    """The margin from which on rows count as label 1 with the best F score, and that score; midway between two rows."""
    order = np.argsort(-margin, kind="stable")
    z, hit = margin[order], np.cumsum(labels[order])
    f = (1 + beta**2) * hit / (np.arange(1, len(z) + 1) + beta**2 * labels.sum())
    f[:-1][z[1:] == z[:-1]] = 0  # rows of one margin go together
    at = int(np.argmax(f))
    return float(z[at] + z[min(at + 1, len(z) - 1)]) / 2, float(f[at])


def chosen(term_lists: list[np.ndarray], labels: np.ndarray, threshold: float = 0.3, settings: tuple[tuple[int, float], ...] = SETTINGS, folds: int = FOLDS, **options) -> Machine:
    """A machine trained on all rows. Its setting is the one that does best on rows not trained on,
    fold by fold, and it is shifted so that ``threshold`` parts these best, by F score."""
    fold = np.arange(len(labels)) % folds
    if any(not 0 < labels[fold == f].sum() < (fold == f).sum() for f in range(folds)):
        return train(term_lists, labels, settings[-1][0], drop=settings[-1][1], **options)
    found = []
    for keep, drop in settings:
        margin = np.empty(len(labels))
        for f in range(folds):
            machine = train([t for t, g in zip(term_lists, fold) if g != f], labels[fold != f], keep, drop=drop, **options)
            margin[fold == f] = machine.margin([t for t, g in zip(term_lists, fold) if g == f])
        cut, reached = best_cut(margin, labels)
        found.append((-reached, keep, drop, cut))
    _, keep, drop, cut = min(found)
    machine = train(term_lists, labels, keep, drop=drop, **options)
    machine.shift = float(np.log(threshold / (1 - threshold))) - cut
    return machine


def held_out(doc_id):
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, threshold: float = 0.3, **options) -> Machine:
    """Train on at most ``sample_rows`` labelled documents, those with the lowest hash of doc_id.

    Only their terms come to the driver. Rows with a null id or label are left out; of repeated
    labels the largest counts. Without labelled documents the machine gives every text one score.
    They stand in an order of their hashes, in which folds are alike."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample has sample_rows rows of two numbers, whatever the corpus: small enough to broadcast.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = [terms(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.float64()), pa.array(lists, pa.binary())], names=["doc_id", "toxic", "terms"])

    found = rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic double, terms binary").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["terms"])))  # whatever order tasks end in
    return chosen([np.frombuffer(r["terms"], dtype=np.int32) for r in found], np.array([float(r["toxic"]) for r in found]), threshold, **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    A null text counts as empty; an empty one gets the score of no terms. Whole texts are read, the
    score depends on the text alone. Other columns are ignored; repeated rows are scored each; an
    empty table gives an empty table. The machine, about 1 MB whatever the corpus, goes along
    with the tasks' code."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                s = machine.score([terms(t) for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    scored = rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, threshold: float = 0.3) -> DataFrame:
    """Train on the labelled rows of ``docs`` that are not held out, then score all of ``docs``."""
    return score(docs, fit(docs, labels, sample_rows, threshold), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns kept, in one pass and no shuffle."""
    machine = fit(docs, labels, sample_rows, threshold)

    @F.pandas_udf("double")
    def scores(text):
        import pandas as pd

        parts = [machine.score([terms(t) for t in text.iloc[at : at + 500]]) for at in range(0, len(text), 500)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(scores(text_or_empty()) < threshold)
