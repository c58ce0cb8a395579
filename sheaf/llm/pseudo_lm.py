"""Masked pseudo-likelihood scores of documents.

A small network sees the words on both sides of a masked place and predicts the word there: first
its class, then the word in the class, both by a softmax over the same hidden layer. The sum of the
log-probabilities of all places of a document is its score. Words are counted over all documents;
the vocabulary grows with them, and the words beyond it stand behind hashed symbols that the network
treats as words, each with the share of its symbol that it has by count. It is trained in numpy on
the executors, each partition on its own places, and averaged.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sheaf.llm.shared import shuffle_width, staged, text_or_empty

#: Words in the vocabulary for each square root of a token, and one hashed symbol for so many of them.
GROWTH, WORDS_PER_SYMBOL = 0.25, 8
SIDE, WIDTH, HIDDEN = 2, 8, 15
#: Places of one step of training: one in so many of all, within these bounds.
STEPS, LEAST_BATCH, BATCH = 2000, 256, 12288
#: The rate of a step (Adagrad), and what sums of squared gradients start from.
RATE, START = 0.1, 1e-6
#: Texts split into words together.
TOGETHER = 1000
#: Pieces of a network that are averaged apart.
PIECES = 64


@dataclass
class Words:
    """Symbols by falling count: frequent words, and after them the hashed symbols of all others.

    ``totals`` has how often the words of each hashed symbol occur. A class is ``span`` symbols in a
    row, and a step of training has ``batch`` places."""

    ids: dict[str, int]
    totals: np.ndarray
    batch: int

    @property
    def hashed(self) -> int:
        return len(self.totals)

    @property
    def size(self) -> int:
        return len(self.ids) + self.hashed

    @property
    def span(self) -> int:
        return max(1, math.isqrt(self.size))

    @property
    def edge(self) -> int:
        """Stands for places outside a text."""
        return self.size

    @property
    def classes(self) -> int:
        return -(-self.size // self.span)

    def of(self, distinct: pa.Array | list[str]) -> np.ndarray:
        distinct = distinct if isinstance(distinct, pa.Array) else pa.array(distinct, pa.string())
        found = pc.index_in(distinct, pa.array(list(self.ids), distinct.type))
        symbols = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        far = symbols < 0
        symbols[far] = np.fromiter(map(zlib.crc32, _bytes(distinct, far)), np.int64) % self.hashed + len(self.ids)
        return symbols


def _bytes(distinct: pa.Array, some: np.ndarray) -> list[bytes]:
    """Those words for which ``some`` is true, in UTF-8."""
    return distinct.filter(pa.array(some)).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of some texts, lower-cased, as places in an array of the distinct ones; that array; words of each text."""
    # at white space that ends an array, utf8_split_whitespace reads one character too many, and may leave it in the word
    words = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(pc.utf8_lower(texts)))
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    at, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    if (none := distinct.index("").as_py()) >= 0:  # white space at the start of a text, or no words
        empty = at == none
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        at = at[~empty]
    return at, distinct, sizes


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    return (texts.slice(at, TOGETHER) for at in range(0, len(texts), TOGETHER))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for texts in _slices(b.column(0)):
                at, distinct, _ = split(texts)
                n = np.bincount(at, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(n)], names=["word", "n"])

    words = docs.select(text_or_empty().alias("text")).mapInArrow(batches, "word string, n long").filter("n > 0")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, growth: float = GROWTH) -> Words:
    """The most frequent words, ``growth`` times the square root of the number of tokens; the others
    stand behind hashed symbols."""
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(16, math.ceil(growth * math.sqrt(tokens)))
    hashed = -(-size // WORDS_PER_SYMBOL)
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    totals = np.zeros(hashed, np.int64)
    for r in counts.groupBy(_symbol(hashed).alias("symbol")).agg(F.sum("n").alias("n")).collect():
        totals[r["symbol"]] = r["n"]
    for r in top:
        totals[zlib.crc32(r["word"].encode()) % hashed] -= r["n"]
    return Words({r["word"]: i for i, r in enumerate(top)}, totals, int(min(BATCH, max(LEAST_BATCH, tokens // STEPS))))


def _symbol(hashed: int):
    return F.crc32(F.col("word").cast("binary")) % hashed


def shares(counts: DataFrame, words: Words) -> DataFrame:
    """word, log_share: the logarithm of what a word beyond the vocabulary has of its symbol, by count."""
    spark = counts.sparkSession
    totals = spark.createDataFrame([(i, int(n)) for i, n in enumerate(words.totals) if n > 0], "symbol long, total long")
    return counts.withColumn("symbol", _symbol(words.hashed)).join(F.broadcast(totals), "symbol").select("word", F.log(F.col("n") / F.col("total")).alias("log_share"))


def with_shares(scored: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """key, more: what the shares of its words beyond the vocabulary add to the score of a row.

    Words meet their shares by the 64-bit hash that Spark's xxhash64 gives; of two with the same
    hash the larger share counts."""
    by_hash = shares(counts, words).groupBy(F.xxhash64("word").alias("h")).agg(F.max("log_share").alias("log_share"))
    far = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("f")).select("key", F.col("f.words").alias("h"), F.col("f.times").alias("times"))
    return far.join(by_hash, "h").groupBy("key").agg(F.sum(F.col("times") * F.col("log_share")).alias("more"))


Net = dict[str, np.ndarray]


def new_net(words: Words, seed: int = 3) -> Net:
    """Embeddings, the hidden layer, classes, and words of each class; biases are the last row but in embeddings."""
    rng = np.random.default_rng(seed)
    net = {
        "e": rng.normal(0, 0.3, (words.size + 1, WIDTH)),
        "w": rng.normal(0, 0.3, (2 * SIDE * WIDTH + 1, HIDDEN)),
        "v": rng.normal(0, 0.1, (HIDDEN + 1, words.classes)),
        "u": rng.normal(0, 0.1, (words.classes, HIDDEN + 1, words.span)),
    }
    return {k: v.astype(np.float32) for k, v in net.items()}


def pack(net: Net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def unpack(flat: np.ndarray, like: Net) -> Net:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def windows(flat: np.ndarray, sizes: np.ndarray, edge: int) -> np.ndarray:
    """Contexts (places x 2 SIDE) of the symbols of some texts in a row."""
    padded = np.full(len(flat) + SIDE * (len(sizes) + 1), edge, np.int32)
    at = np.arange(len(flat)) + SIDE * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded[at] = flat
    return np.stack([padded.take(at + d) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _hidden(net: Net, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of the context; the hidden layer with a last column of ones for the bias; and the
    weights between them, whose last column makes these ones: tanh 20 is 1."""
    w = np.zeros((len(net["w"]), net["w"].shape[1] + 1), net["w"].dtype)
    w[:, :-1], w[-1, -1] = net["w"], 20
    e = net["e"].take(context.ravel(), axis=0).reshape(len(context), -1)
    h = e @ w[:-1]
    h += w[-1]
    return e, np.tanh(h, out=h), w


def _most(net: Net) -> float:
    """No place gives a class or a word more than this, nor less than its negative: the hidden layer is from -1 to 1."""
    return max(float(np.abs(net[k]).sum(axis=-2).max()) for k in ("v", "u"))


def _powers(z: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray | float]:
    """exp of each row, over its largest where that could overflow, in place; and what was taken off."""
    off = 0.0
    if most > 60 and len(z) and np.abs(z).max() > 60:
        off = z.max(axis=1)
        z -= off[:, None]
    return np.exp(z, out=z), off


def _sums(q: np.ndarray) -> np.ndarray:
    return q @ np.ones(q.shape[1], q.dtype)


def _by_symbol(words: Words, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places in order of their symbols, these symbols, and (class, first, end) of each class among them."""
    order = np.argsort(target.astype(np.uint16 if words.size < 65536 else np.int64), kind="stable")
    y = target.take(order)
    cut = np.searchsorted(y, np.arange(words.classes + 1) * words.span).tolist()
    return order, y, [(c, a, e) for c, (a, e) in enumerate(zip(cut, cut[1:])) if a < e]


def _by_rows(net: Net) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each symbol in its class, a row for each; and, flat, those by which a place gives it together with its class."""
    u = net["u"].transpose(0, 2, 1).copy()
    return u, (u + net["v"].T[:, None, :]).reshape(-1, u.shape[2])


def _room(words: Words, c: int) -> int:
    """Symbols of class ``c``; the last one may have fewer than the others."""
    return min(words.span, words.size - c * words.span)


def _push(h: np.ndarray, weights: np.ndarray, back: np.ndarray, scale: np.float32, most: float, grown: np.ndarray) -> np.ndarray:
    """Gradient of the logarithm of a softmax's sum by ``h``, times ``scale``, and in ``grown``, with a
    row for each column of ``weights``, that by the weights. ``back`` is the transposed weights with
    ones in the last column: so the sums come with the product, and no share is divided by its sum."""
    q, _ = _powers(h @ weights, most)
    g = q @ back
    over = scale / g[:, -1:]
    np.matmul(q.T, h * over, out=grown)
    g *= over
    return g


def train_on(net: Net, words: Words, context: np.ndarray, target: np.ndarray, seen: Net, rate: float = RATE) -> None:
    """Adagrad steps, in place, over the given places once; ``seen`` holds the sums of squared gradients."""
    cells = np.arange(net["e"].size).reshape(net["e"].shape)
    gv, gu = np.zeros_like(net["v"].T, order="C"), np.zeros_like(net["u"].transpose(0, 2, 1), order="C")
    for first in range(0, len(target), words.batch):
        order, y, groups = _by_symbol(words, target[first : first + words.batch])
        x = context[first : first + words.batch].take(order, axis=0)
        scale, most = np.float32(1 / len(y)), _most(net)
        e, h, w = _hidden(net, x)
        back, right = _by_rows(net)
        back_v = net["v"].T.copy()
        back[:, :, -1] = back_v[:, -1] = 1
        gu[:] = 0
        gh = _push(h, net["v"], back_v, scale, most, gv)
        for c, a, z in groups:
            m = _room(words, c)
            gh[a:z] += _push(h[a:z], net["u"][c, :, :m], back[c, :m], scale, most, gu[c, :m])
        # less what the class and the word that are right have: places of a symbol stand together
        at = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        own = np.zeros_like(right)
        own[y[at]] = scale * np.add.reduceat(h, at, axis=0)
        own = own.reshape(gu.shape)
        gu -= own
        gv -= own.sum(axis=1)
        gh -= scale * right.take(y, axis=0)
        gh *= 1 - h * h  # 0 in the column of ones
        gw = np.concatenate([e.T @ gh, _sums(gh.T)[None]])[:, :-1]
        ge = np.bincount(cells.take(x.ravel(), axis=0).ravel(), weights=(gh @ w[:-1].T).ravel(), minlength=cells.size)
        for k, g in (("e", ge.astype(np.float32).reshape(cells.shape)), ("w", gw), ("v", gv.T), ("u", np.ascontiguousarray(gu.transpose(0, 2, 1)))):
            seen[k] += g * g
            net[k] -= np.float32(rate) * g / np.sqrt(seen[k])


def log_probabilities(net: Net, words: Words, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(symbol | both sides) of each place."""

    def log_sums(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        q, off = _powers(h @ weights, most)
        return np.log(_sums(q)) + off

    out, most, right = np.empty(len(target)), _most(net), _by_rows(net)[1]
    for first in range(0, len(target), BATCH):
        order, y, groups = _by_symbol(words, target[first : first + BATCH])
        h = _hidden(net, context[first : first + BATCH].take(order, axis=0))[1]
        p = np.einsum("ij,ij->i", h, right.take(y, axis=0)) - log_sums(h, net["v"]).astype(np.float64)
        for c, a, end in groups:
            p[a:end] -= log_sums(h[a:end], net["u"][c, :, : _room(words, c)])
        out[first + order] = p
    return out


def _parts(texts: pa.Array, words: Words) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """For some texts at a time what ``split`` gives, and the symbols of the distinct words."""
    for part in _slices(texts):
        at, distinct, sizes = split(part)
        yield at, distinct, sizes, words.of(distinct)


def _some(texts: pa.Array, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts, symbols and numbers of words of some texts at a time."""
    for at, _, sizes, symbols in _parts(texts, words):
        target = symbols[at]
        yield windows(target, sizes, words.edge), target, sizes


def _beyond(at: np.ndarray, distinct: pa.Array, of: np.ndarray, far: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """For each of some texts, hashes of its words beyond the vocabulary (``far``) and how often it has them."""
    import xxhash

    hashes = np.zeros(len(distinct), np.uint64)
    hashes[far] = np.array([xxhash.xxh64_intdigest(w, 42) for w in _bytes(distinct, far)], np.uint64)
    there, width = far[at], max(1, len(distinct))
    pair, times = np.unique(of[there] * width + at[there], return_counts=True)
    offsets = pa.array(np.searchsorted(pair, np.arange(texts + 1) * width), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)[pair % width], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))


def train(docs: DataFrame, words: Words) -> Net:
    """One round of training on all of every partition's own places, shuffled some documents at a
    time, and averaging by number of places. The average is taken piece by piece on the executors,
    as a stream; the driver gets it once. Rows in another order, or dealt to other partitions, give
    another average of the same kind."""
    spark = docs.sparkSession
    net = new_net(words)
    texts = docs.select(text_or_empty().alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = {k: v.copy() for k, v in net.items()}, 0
        seen = {k: np.full_like(v, START) for k, v in net.items()}
        for b in it:
            for context, target, _ in _some(b.column(0), words):
                mixed = np.random.default_rng(places).permutation(len(target))
                train_on(own, words, context.take(mixed, axis=0), target.take(mixed), seen)
                places += len(target)
        if places:
            parts = [p.tobytes() for p in np.array_split(pack(own), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([places] * PIECES, pa.int64()), pa.array(parts, pa.binary())], names=["piece", "places", "net"])

    def average(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        places: Counter = Counter()
        for b in it:
            for piece, n, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(flat.as_py(), dtype=np.float32).astype(np.float64) * n
                total[piece] = total[piece] + x if piece in total else x
                places[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / places[k]).astype(np.float32).tobytes() for k, x in total.items()], pa.binary())], names=["piece", "net"])

    own = texts.mapInArrow(batches, "piece int, places long, net binary")
    parts = own.repartition(min(PIECES, shuffle_width(spark)), "piece").mapInArrow(average, "piece int, net binary").collect()
    if not parts:
        return net
    return unpack(np.concatenate([np.frombuffer(p["net"], dtype=np.float32) for p in sorted(parts, key=lambda p: p["piece"])]), net)


def symbol_scores(docs: DataFrame, net: Net, words: Words) -> DataFrame:
    """key, doc_id, n_tokens, score of the symbols, and words (their hashes) and times: what of the text is beyond the vocabulary.

    ``key`` is a number of the row's own; it is to be written before it is used twice."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for b in it:
            first = 0
            for at, distinct, sizes, symbols in _parts(b.column(1), words):
                target, of = symbols[at], np.repeat(np.arange(len(sizes)), sizes)
                logs = log_probabilities(net, words, windows(target, sizes, words.edge), target)
                total = np.bincount(of, weights=logs, minlength=len(sizes))
                far = _beyond(at, distinct, of, symbols >= len(words.ids), len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(sizes)) + key), b.column(0).slice(first, len(sizes)), pa.array(sizes), pa.array(total), *far], names=["key", "doc_id", "n_tokens", "score", "words", "times"])
                first += len(sizes)
                key += len(sizes)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"key long, doc_id {kind}, n_tokens long, score double, words array<long>, times array<int>")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_probability per row of ``docs``.

    Tokens are white-space separated words, lower-cased; null text counts as empty and has no
    tokens, log-likelihood 0 and a null mean. Every row is counted, trained on and scored, repeated
    ones each; other columns are ignored; an empty table gives an empty table. A word beyond the
    vocabulary has the probability of its symbol times its share of it, which a join brings to the
    texts that have it."""
    counts = staged(count_words(docs), "word-counts")
    words = vocabulary(counts)
    net = train(docs, words)
    scored = staged(symbol_scores(docs, net, words), "symbol-scores")
    more = with_shares(scored, counts, words)
    both = scored.select("key", "doc_id", "n_tokens", "score").join(more, "key", "left").withColumn("log_likelihood", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return both.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))
