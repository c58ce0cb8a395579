"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Suffixes are dealt to buckets by the content anchor of their first 200 bytes (see ``anchors``), so
that suffixes which agree on 200 bytes share a bucket. Buckets whose suffixes are plainly alone or
plainly repeated are settled by hashes of whole contexts. In the others, one block of buckets at a
time, suffixes are sorted: first by 16 bytes, then long ties by the ranks of a precomputed
difference-cover sample, which bounds memory by the block. Adjacent suffixes that agree on 200 bytes
are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheaf.llm import anchors as places
from sheaf.llm.shared import packed_texts, shuffle_width, staged, text_or_empty

LENGTH = 200
#: A difference cover of the integers modulo PERIOD: any two residues are moved into it by one shift.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Bytes of contexts sorted as one block.
BLOCK = 3 << 19
#: An anchor is hot if a sixteenth of the documents holds at least so many different contexts of it,
#: and more than a shuffle partition's share of these documents. Its windows go by hashes, not by bucket.
HOT_IN_SAMPLE = 16
#: At most so many hot anchors are treated apart; further ones are right too, in one bucket each.
HOT_ANCHORS = 20_000

_in_cover = np.isin(np.arange(PERIOD), COVER)
#: Least shift that moves both residues into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if _in_cover[(a + d) % PERIOD] and _in_cover[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class SampleRanks:
    """Ranks of the sample positions of a block by their first 16, 32, 64 and 128 bytes."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(2 * 128, np.uint8)])
        n = len(data)
        at = np.flatnonzero(_in_cover[np.arange(n + 1) % PERIOD])
        self.index = np.zeros(n + 128 + 1, np.int64)  # beyond the end: the last sample, never decisive
        self.index[at] = np.arange(len(at))
        high, low = self.word(at), self.word(at + 8)
        order = np.lexsort((low, high))
        new = np.concatenate([[0], ((high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])).astype(np.int64)])
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        self.rank, size = {16: rank}, 16
        while size < 128:
            after = rank[self.index[np.minimum(at + size, at[-1])]]
            rank = np.unique((rank << 32) | after, return_inverse=True)[1]
            size *= 2
            self.rank[size] = rank

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place as a number that sorts as they do."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        return view[at].copy().view(">u8").ravel().astype(np.uint64)

    def compare(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """-1, 0, 1 for pairs of suffixes that agree on 16 bytes, by their first ``length`` bytes."""
        sign, done = np.zeros(len(a), np.int8), 16
        while True:
            base = done - PERIOD + 1
            size = next((s for s in (128, 64, 32) if base + PERIOD - 1 + s <= length), 0)
            if base + size < done + 16:
                break
            shift = base + SHIFT[(a + base) % PERIOD, (b + base) % PERIOD]
            r = self.rank[size]
            x, y = r[self.index[a + shift]], r[self.index[b + shift]]
            sign = np.where(sign == 0, (x > y).astype(np.int8) - (x < y).astype(np.int8), sign)
            done = base + size
        while done < length:
            at = min(done, length - 8)
            x, y = self.word(a + at), self.word(b + at)
            sign = np.where(sign == 0, (x > y).astype(np.int8) - (x < y).astype(np.int8), sign)
            done = at + 8
        return sign


def repeated_suffixes(data: np.ndarray, suffixes: np.ndarray, buckets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``suffixes`` (positions in ``data``) share their first ``length`` bytes with another of
    their bucket. Sorts by bucket and 16 bytes, then splits ties three ways round by round, all ties
    at once, each against a suffix of its own."""
    ranks = SampleRanks(data)
    high, low = ranks.word(suffixes), ranks.word(suffixes + 8)
    order = np.lexsort((low, high, buckets))
    b, h, w = buckets[order], high[order], low[order]
    group = np.cumsum(np.concatenate([[0], ((b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])).astype(np.int64)])) if len(order) else order
    repeated = np.zeros(len(suffixes), bool)
    rng = np.random.default_rng(0)
    while len(order):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        tied = np.repeat(sizes > 1, sizes)
        order, group = order[tied], group[tied]
        first, sizes = None, sizes[sizes > 1]
        if not len(order):
            break
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pivot = order[first + (rng.random(len(sizes)) * sizes).astype(np.int64)]
        pivots = np.repeat(pivot, sizes)
        sign = ranks.compare(suffixes[order], suffixes[pivots], length)
        equal = sign == 0
        several = np.repeat(np.add.reduceat(equal.astype(np.int64), first) > 1, sizes)
        repeated[order[equal & several]] = True
        number = np.repeat(np.arange(len(sizes)), sizes) * 2 + (sign > 0)
        order, number = order[~equal], number[~equal]
        again = np.argsort(number, kind="stable")
        order, group = order[again], number[again]
    return repeated


SPAN, CONTEXT, HOT_CONTEXT = 0, 1, 2


def _empty(n: int) -> list[np.ndarray]:
    return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.uint32, np.uint16, np.uint16)][:n]


def _anchors_of(ids: list[int], texts: list[str], length: int):
    """Anchors of some documents: hash, context hash, doc_id, first window, windows, place of the anchor."""
    parts = [_empty(6)]
    for k, (doc_id, text) in enumerate(zip(ids, texts)):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        first, last, place = places.anchors(data, length)
        if len(first):
            of = places.Hashes(data)
            off = (place - first).astype(np.uint64)
            context = of.of(first, last + length) + off * np.uint64(0xA0761D6478BD642F)
            parts.append([of.of(place, place + places.GRAM), context, np.full(len(first), k, np.int64), first.astype(np.uint32), (last - first + 1).astype(np.uint16), off.astype(np.uint16)])
    return [np.concatenate([p[i] for p in parts]) for i in range(6)]


def _slices(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[list, list]]:
    for b in it:
        for at in range(0, b.num_rows, rows):
            some = b.slice(at, rows)
            yield some.column(0).to_pylist(), some.column(1).to_pylist()


def _contexts_in_sample(length: int):
    """Anchor hashes with several different contexts among some documents, and how many."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(it):
            h, c, *_ = _anchors_of(ids, texts, length)
            pair = np.unique(np.stack([h, c], axis=1), axis=0)[:, 0]
            own, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    return batches


PACKED = "bucket int, kind int, hashes binary, contexts binary, docs binary, starts binary, windows binary, offsets binary, sure binary"


def _survey(buckets: int, length: int, hot: np.ndarray):
    """Documents -> anchors by bucket. Contexts that repeat among some documents are settled here: their
    bytes become spans, and one of them goes on as sure. Contexts of hot anchors are dealt one by one."""

    def row(bucket, kind, h, c, d, s, w, o, sure):
        return [bucket, kind, h.tobytes(), c.tobytes(), d.tobytes(), s.tobytes(), w.tobytes(), o.tobytes(), sure.tobytes()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(it):
            h, c, k, s, w, o = _anchors_of(ids, texts, length)
            doc = np.array(ids, dtype=np.int64)
            rows = []
            order = np.lexsort((c, h))
            h, c, k, s, w, o = (a[order] for a in (h, c, k, s, w, o))
            if len(h):
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
                sizes = np.diff(np.append(first, len(h)))
                twice = np.repeat(sizes > 1, sizes)
                if twice.any():
                    kk, start, end = k[twice], s[twice].astype(np.int64), s[twice].astype(np.int64) + w[twice] + (length - 1)
                    of, a, b = merged(kk, start, end)
                    rows.append(row(int(h[0] % np.uint64(buckets)), SPAN, h[:0], c[:0], doc[of], a.astype(np.uint32), w[:0], o[:0], b.astype(np.uint32).view(np.uint8)))
                sure = (sizes > 1).astype(np.uint8)
                h, c, k, s, w, o = (a[first] for a in (h, c, k, s, w, o))
                is_hot = np.isin(h, hot)
                to = (np.where(is_hot, h ^ c, h) % np.uint64(buckets)).astype(np.int64) * 2 + is_hot
                order = np.argsort(to, kind="stable")
                h, c, k, s, w, o, sure, to = (a[order] for a in (h, c, k, s, w, o, sure, to))
                cut = np.flatnonzero(np.diff(np.concatenate([[-1], to])))
                for a, e in zip(cut, np.append(cut[1:], len(to))):
                    rows.append(row(int(to[a] // 2), HOT_CONTEXT if to[a] % 2 else CONTEXT, h[a:e], c[a:e], doc[k[a:e]], s[a:e], w[a:e], o[a:e], sure[a:e]))
            if rows:
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
                names = [x.split()[0] for x in PACKED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows), kinds)], names=names)

    return batches


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans per document, touching ones as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = np.maximum.accumulate(end + doc * (1 << 34)) if len(doc) else end  # within a document: the largest end so far
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] + doc[1:] * (1 << 34) > far[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], start[first], far[last] - doc[first] * (1 << 34)


FOUND = "kind int, doc_id long, start long, end long, h long, sure boolean"


def _settle(length: int):
    """Per bucket: contexts that occur twice are spans; those alone under their anchor are unique; the
    rest, one of each sure context and all others, has to be sorted. Contexts of a hot anchor are
    spread over the buckets, so all of them are taken for open."""

    def out(kind, doc, start, end, h=None, sure=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)), pa.array(doc, pa.int64()), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)),
            pa.array((h if h is not None else np.zeros(n, np.uint64)).view(np.int64)), pa.array(sure if sure is not None else np.zeros(n, bool)),
        ], names=["kind", "doc_id", "start", "end", "h", "sure"])

    def settle(rows: list[tuple]):
        join = lambda col, t, some: np.frombuffer(b"".join(r[col] for r in some), dtype=t)
        spans = [r for r in rows if r[1] == SPAN]
        if spans:
            yield out(SPAN, join(4, np.int64, spans), join(5, np.uint32, spans), join(8, np.uint32, spans))
        for kind in (CONTEXT, HOT_CONTEXT):
            some = [r for r in rows if r[1] == kind]
            if not some:
                continue
            h, c, d, s = join(2, np.uint64, some), join(3, np.uint64, some), join(4, np.int64, some), join(5, np.uint32, some).astype(np.int64)
            w, sure = join(6, np.uint16, some).astype(np.int64), join(8, np.uint8, some) > 0
            order = np.lexsort((s, d, c, h))
            h, c, d, s, w, sure = (a[order] for a in (h, c, d, s, w, sure))
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            sizes = np.diff(np.append(first, len(h)))
            certain = (sizes > 1) | np.maximum.reduceat(sure, first)
            each = np.repeat(certain, sizes)
            if each.any():
                yield out(SPAN, d[each], s[each], s[each] + w[each] + (length - 1))
            open_ = np.ones(len(first), bool)
            if kind == CONTEXT:
                h1 = h[first]
                head = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
                n = np.diff(np.append(head, len(h1)))
                open_ = np.repeat((n > 1) & ~np.minimum.reduceat(certain, head), n)
            pick = first[open_]
            if len(pick):
                yield out(kind, d[pick], s[pick], s[pick] + w[pick] + (length - 1), h[pick], certain[open_])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != now:
                    if rows:
                        yield from settle(rows)
                    now, rows = r[0], []
                rows.append(r)
        if rows:
            yield from settle(rows)

    return batches


def _cut_contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in it:
        for at in range(0, b.num_rows, 200):
            some = b.slice(at, 200)
            out = [[], [], [], [], []]
            for doc_id, packed, parts in zip(*(c.to_pylist() for c in some.columns)):
                text = z.decompress(packed)
                for p in parts:
                    for col, x in zip(out, (p["h"], doc_id, p["start"], p["sure"], text[p["start"] : p["end"]])):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["h", "doc_id", "start", "sure", "bytes"])


def _cut_windows(length: int):
    """Contexts of hot anchors -> the hash of each window."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in it:
            for doc_id, packed, parts in zip(*(c.to_pylist() for c in b.columns)):
                data = np.frombuffer(z.decompress(packed), dtype=np.uint8)
                n = np.array([p["end"] - p["start"] - length + 1 for p in parts])
                at = np.concatenate([np.arange(p["start"], p["end"] - length + 1) for p in parts])
                h = places.Hashes(data).of(at, at + length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h.view(np.int64)), pa.array(np.full(len(at), doc_id, np.int64)), pa.array(at), pa.array(np.repeat([p["sure"] for p in parts], n))],
                    names=["h", "doc_id", "start", "sure"])

    return batches


def _sort_buckets(length: int):
    """Contexts sorted by bucket -> spans of repeated suffixes, a block of whole buckets at a time."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[4]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        bucket = np.array([r[0] for r in rows])[row]
        found = repeated_suffixes(data, begin[row] + step, bucket, length)
        found &= ~np.array([r[3] for r in rows])[row]
        start = (np.array([r[2] for r in rows])[row] + step)[found]
        of, a, b = merged(row[found], start, start + length)
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows])[of], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "start", "end"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != now and held >= BLOCK:
                    yield sort(rows)
                    rows, held = [], 0
                now = r[0]
                rows.append(r)
                held += len(r[4])
        if rows:
            yield sort(rows)

    return batches


def _cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in it:
        for at in range(0, b.num_rows, 200):
            some = b.slice(at, 200)
            ids, size, gone, runs, kept, removed = [], [], [], [], [], []
            for doc_id, packed, spans in zip(*(c.to_pylist() for c in some.columns)):
                text = z.decompress(packed)
                start = np.array([s["start"] for s in spans or ()], dtype=np.int64)
                end = np.array([s["end"] for s in spans or ()], dtype=np.int64)
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                rest = [text[a:e] for a, e in zip([0, *end], [*start, len(text)])]
                ids.append(doc_id), size.append(len(text)), gone.append(int((end - start).sum())), runs.append(len(start))
                kept.append(hashlib.sha256(b"".join(rest)).hexdigest())
                removed.append([{"start": int(a), "end": int(e)} for a, e in zip(start, end)])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges taken out) per row of ``docs``.

    Removed is every byte of a ``length``-byte string that starts anywhere else too, in another
    document or the same one, overlaps included, judged on the input. Texts are UTF-8 bytes, null as
    empty; texts below ``length`` bytes never lose any. Each row is judged by its own text: where a
    doc_id stands on different texts, rows go under a hash of both, and rows without doc_id under
    one of their text. Rows that repeat id and text are copies. Other columns are ignored; an
    empty table gives an empty table. Contexts and windows of hot anchors are told apart by 64-bit
    hashes, all other suffixes by their bytes.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    nameless = rows.filter("doc_id IS NULL").select(F.xxhash64("text").alias("doc_id"), "text")
    known = rows.filter("doc_id IS NOT NULL")
    texts_of = known.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    shared = staged(texts_of.filter("a <> b").select("doc_id"), "shared-ids")
    several = None
    if not shared.isEmpty():
        several = known.join(shared, "doc_id", "left_semi").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
        known = known.join(shared, "doc_id", "left_anti")
    rows = known.union(nameless)
    if several is not None:
        rows = rows.union(several.select("key", "text"))

    # which way anchors go depends on this list of bounded length, the result does not
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0)
    least = max(HOT_IN_SAMPLE, -(-sample.count() // width))
    hot = sample.mapInArrow(_contexts_in_sample(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    hot = np.array(sorted(r["h"] for r in hot.orderBy(F.desc("n"), "h").limit(HOT_ANCHORS).collect()), dtype=np.int64).view(np.uint64)

    packed = rows.mapInArrow(_survey(width * 4, length, hot), PACKED).repartition(width, "bucket").sortWithinPartitions("bucket")
    found = staged(packed.mapInArrow(_settle(length), FOUND), "anchors")
    spans = found.filter(F.col("kind") == SPAN).select("doc_id", "start", "end")

    def with_texts(kind: int) -> DataFrame:
        parts = found.filter(F.col("kind") == kind).groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "end", "sure")).alias("parts"))
        return packed_texts(rows).join(parts, "doc_id").select("doc_id", "packed", "parts")

    contexts = with_texts(CONTEXT).mapInArrow(_cut_contexts, "h long, doc_id long, start long, sure boolean, bytes binary")
    spans = spans.union(contexts.repartition(width, "h").sortWithinPartitions("h").mapInArrow(_sort_buckets(length), "doc_id long, start long, end long"))
    if len(hot):
        windows = staged(with_texts(HOT_CONTEXT).mapInArrow(_cut_windows(length), "h long, doc_id long, start long, sure boolean"), "windows")
        twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        spot = F.hash("h").alias("spot")
        again = windows.filter("NOT sure").select("*", spot).join(twice.select("h", spot), ["spot", "h"])
        spans = spans.union(again.select("doc_id", "start", (F.col("start") + length).alias("end")))

    every = staged(spans, "spans").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(some: DataFrame) -> DataFrame:
        return packed_texts(some).join(every, "doc_id", "left").select("doc_id", "packed", "spans").mapInArrow(
            _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")

    out = cut(known).union(cut(nameless).withColumn("doc_id", F.lit(None).cast("long")))
    if several is not None:
        ids = several.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
        own = cut(several.select(F.col("key").alias("doc_id"), "text"))
        out = out.union(own.join(ids, F.col("doc_id") == F.col("_key")).withColumn("doc_id", F.col("_id")).select(*out.columns))
    return out
