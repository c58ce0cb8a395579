"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of hashed word shingles; equal sets count once through all steps. Two sets with a
Jaccard similarity of at least p % overlap in a number of shingles that grows with their sizes,
which gives four exact steps:

1. Sets are reduced to their least shingle hashes. Partners must share a share of those, so a set
   of whose reduced shingles too few occur in any other set has no partner. Most sets end here.
2. In how many of the sets left each of their shingles occurs is counted. A set of which too few
   shingles occur in another one ends here. The others are ordered by that number, rare shingles
   first; partners share one of the first n - T + 1, where T is the least overlap. A shingle sends
   the sets that have it among those to the block of the least set of them, its center.
3. Inside a block, whose inverted lists are local, each set searches for the sets that overlap in T
   shingles: short lists are merged by a heap with skips, long ones probed by binary search
   (DivideSkip). Sets that a search before has united with the largest component need not search:
   each link has an end that does, or joins what is joined. Out comes a tree of the links.
4. Blocks too large for one task are searched part by part, then the sets outside the block's largest
   component are searched for in the other parts.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheaf.llm.components import components
from sheaf.llm.shared import packed_texts, shuffle_width, staged, text_or_empty

WORDS = 5
PERCENT = 80
#: Usual sets that are searched together by one task; longer ones count for more.
PART = 512
#: Shingles of a usual set.
USUAL = 512
#: Bytes of text whose reduced shingles are dealt to one bucket, about.
BUCKET = 32 << 20
#: Searches before the largest component of a part is told.
FIRST = 16

#: Reduced sets hold a part of so many more shingles than partners may differ in. A smaller number means
#: more shingles to move and fewer sets left.
SHARE = 5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_letters = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_turns = _mix(np.arange(1, 65, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)



def _word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, all words at once, by letters and their places; and where each begins."""
    space = _SPACE[b]
    edge = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1], [not space[-1]]]))
    sizes = edge[1::2] - edge[0::2]
    if not len(sizes):
        return np.zeros(0, np.uint64), edge
    letters = b[~space]
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(begin, sizes)
    long = place >= 64
    each = _letters[letters] * _turns[place & 63]
    if long.any():
        each[long] = _mix(each[long] + (place[long] >> 6).astype(np.uint64) * _MULTIPLIER)
    return _mix(np.add.reduceat(each, begin) ^ sizes.astype(np.uint64)), edge[0::2]


def shingle_sets(texts: list[str], words: int = WORDS, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """Of each whole text the distinct 64-bit hashes of its word shingles, ascending; A-Z lower-cased first.

    Fewer words than ``words`` make one shingle, no word none. Texts are hashed together, about
    ``at_once`` bytes at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        size += len(held[-1])
        if size >= at_once or i == len(texts) - 1:
            yield from _sets_of(held, words)
            held, size = [], 0


def _sets_of(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    b = _LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
    w, begin = _word_hashes(b) if len(b) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    cut = np.searchsorted(begin, np.cumsum([0] + [len(r) + 1 for r in raw]))
    h = np.full(max(0, len(w) - words + 1), words, np.uint64)
    for k in range(words):
        h += w[k : k + len(h)] * _turns[k]
    h = _mix(h)
    for first, end in zip(cut[:-1].tolist(), cut[1:].tolist()):
        n = end - first
        if n >= words:
            s = np.sort(h[first : end - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            yield _mix(np.array([n], np.uint64) + (w[first:end] * _turns[:n]).sum(dtype=np.uint64))
        else:
            yield w[:0]


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of size n with any partner: the partner is then a part of the set."""
    return -(-n * percent // 100)


def reach(n: int, percent: int) -> tuple[int, int]:
    """How many least hashes represent a set of size n, and how many of them a partner must share.

    If two sets overlap in a elements, their (size - a + l) least elements share at least l. Here l
    is a fifth of the size, and that of the smaller of the two, whose size is at least p %."""
    own = max(1, n // SHARE)
    return min(n, n - needed(n, percent) + own), max(1, needed(n, percent) // SHARE)


def band(n: int, percent: int) -> int:
    """Sizes of partners lie in the same band or in neighbouring ones."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def digest_of(s: np.ndarray) -> int:
    """64 bits that stand for a whole set, as a signed number; 0 for the empty one."""
    if not len(s):
        return 0
    mixed = np.bitwise_xor.reduce(_mix(s * _MULTIPLIER)) + np.uint64(len(s))
    return int(_mix(np.array([mixed], dtype=np.uint64)).view(np.int64)[0])


PACKED = "bucket int, kind int, owners binary, shingles binary, extra binary"
_TYPES = [pa.int32()] * 2 + [pa.binary()] * 3
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
#: Kinds of packed rows: documents, shingles of sets, numbers of shared shingles, sizes of sets.
DOCUMENTS, SHINGLES, SHARED, SIZES = 0, 1, 2, 3


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Arrays go as bytes, so that Spark moves few long rows instead of many short ones."""
    columns = [[r[i] if i < 2 else r[i].tobytes() for r in rows] for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


_NOTHING = np.zeros(0, np.int64)


def _dealt(which: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple]:
    """A packed row for each value of ``which``, the bucket of each element of the arrays, two or three."""
    if not len(which):
        return []
    order = np.argsort(which, kind="stable")
    which, arrays = which[order], [a[order] for a in arrays]
    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    rest = [_NOTHING] * (3 - len(arrays))
    return [(int(which[s]), kind, *(a[s:e] for a in arrays), *rest) for s, e in zip(cut, np.append(cut[1:], len(which)))]


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)


class Held:
    """Owners and what goes with them, gathered over the buckets of a task and dealt out by owner."""

    def __init__(self, kind: int, parts: int, most: int = 1 << 22):
        self.kind, self.parts, self.most, self.arrays, self.n = kind, parts, most, [], 0

    def add(self, owners: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.arrays.append((owners, *arrays))
        self.n += len(owners)
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            owners, *arrays = (np.concatenate(a) for a in zip(*self.arrays))
            yield _packed(_dealt(_bucket_of(owners, self.parts), self.kind, owners, *arrays))
        self.arrays, self.n = [], 0


def _column(rows: list[tuple], at: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), dtype=kind)


def _by_key(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of a partition sorted by its first column, those of one value at a time."""
    now, rows = None, []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != now:
                if rows:
                    yield rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield rows


def _pack_reduced(buckets: int, words: int, percent: int):
    """Documents (doc_id, text) -> by bucket the reduced shingles with the digests and bands of their
    sets; and ids, sizes and digests. Equal sets of a batch send their shingles once."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                sizes, digests, alike, heads = [], [], [], {}
                for s in shingle_sets(some.column(1).to_pylist(), words):
                    digest, head = digest_of(s), s[: reach(len(s), percent)[0]] if len(s) else s
                    # half of a shingle's hash goes on; halves that are alike in a set count for shared, so none is lost
                    half = (head >> np.uint64(32)).astype(np.uint32)
                    sizes.append(len(s)), digests.append(digest), alike.append(int((half[1:] == half[:-1]).sum()))
                    if len(s):
                        heads[digest] = head, half, band(len(s), percent)
                ids = some.column(0).to_pylist()
                facts = np.array([sizes, alike, [i is not None for i in ids], [i or 0 for i in ids]], dtype=np.int64)
                digests = np.array(digests, dtype=np.int64)
                rows = [(int(_bucket_of(digests[:1], buckets)[0]), DOCUMENTS, digests, facts, _NOTHING)]
                if heads:
                    long = [len(h[0]) for h in heads.values()]
                    owners, bands = np.repeat(np.array(list(heads), np.int64), long), np.repeat(np.array([h[2] for h in heads.values()], np.uint8), long)
                    which = _bucket_of(np.concatenate([h[0] for h in heads.values()]), buckets)
                    rows += _dealt(which, SHINGLES, owners, np.concatenate([h[1] for h in heads.values()]), bands)
                yield _packed(rows)

    return batches


def _shared_shingles(parts: int):
    """Per bucket: for each set the number of its shingles here that another set of a possible size has,
    dealt into ``parts`` by the set's digest; and the rows of documents as they came."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(SHARED, parts)
        for rows in _by_key(it):
            yield _packed([(r[0], DOCUMENTS, _column([r], 2, np.int64), _column([r], 3, np.int64), _NOTHING) for r in rows if r[1] == DOCUMENTS])
            some = [r for r in rows if r[1] == SHINGLES]
            if some:
                o, s, w = _column(some, 2, np.int64), _column(some, 3, np.uint32), _column(some, 4, np.uint8).astype(np.int16)
                order = np.lexsort((o, w, s))
                s, o, w = s[order], o[order], w[order]
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
                s, o, w = s[new], o[new], w[new]
                # shared: another set of a possible size has it too; in order of bands that is a neighbour
                pair = (s[1:] == s[:-1]) & (w[1:] - w[:-1] <= 1)
                several = np.concatenate([[False], pair]) | np.concatenate([pair, [False]])
                owner, k = np.unique(o[several], return_counts=True)
                yield from held.add(owner, k.astype(np.int32))
        yield from held.rest()

    return batches


def _document_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for owners, facts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            n, alike, known, ids = np.frombuffer(facts, np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(n), pa.array(np.frombuffer(owners, np.int64)), pa.array(alike)], names=["doc_id", "n", "digest", "alike"])


def _sum_shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_key(it):
        owner, at = np.unique(_column(rows, 2, np.int64), return_inverse=True)
        k = np.bincount(at, weights=_column(rows, 3, np.int32), minlength=len(owner)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(k)], names=["digest", "k"])


def _whole_sets(words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in it:
            for at in range(0, b.num_rows, 500):
                sets = list(shingle_sets([z.decompress(t).decode() for t in b.column(1).slice(at, 500).to_pylist()], words))
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    return batches


def _pack_whole(buckets: int, parts: int):
    """Sets (digest, set) -> by bucket all their shingles with the sets' digests; and the sizes of sets, in ``parts``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                digests, sets = np.array(some.column(0).to_pylist(), np.int64), some.column(1).to_pylist()
                n = np.array([len(s) // 8 for s in sets], np.int64)
                flat = np.frombuffer(b"".join(sets), dtype=np.uint64)
                yield _packed(_dealt(_bucket_of(flat, buckets), SHINGLES, np.repeat(digests, n), flat) + _dealt(_bucket_of(digests, parts), SIZES, digests, n))

    return batches


def _frequencies(parts: int):
    """Per bucket: the shingles that several sets have, with the number of these sets, dealt into
    ``parts`` by each set's digest; and the sizes of sets as they came."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(SHARED, parts)
        for rows in _by_key(it):
            yield _packed([(r[0], SIZES, _column([r], 2, np.int64), _column([r], 3, np.int64), _NOTHING) for r in rows if r[1] == SIZES])
            some = [r for r in rows if r[1] == SHINGLES]
            if some:
                o, s = _column(some, 2, np.int64), _column(some, 3, np.uint64)
                order = np.lexsort((o, s))
                s, o = s[order], o[order]
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
                s, o = s[new], o[new]
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                df = np.diff(np.append(first, len(s)))
                df = np.repeat(df, df)
                s, o, df = (a[df > 1] for a in (s, o, df))
                order = np.argsort(o, kind="stable")
                # only the order counts from here on, and any that is the same for all sets will do
                yield from held.add(o[order], s[order], np.minimum(df[order], 65535).astype(np.uint16))
        yield from held.rest()

    return batches


def _rare_first(percent: int):
    """Per bucket of digests -> digest, n, shingle: of each set with enough shared shingles the rarest
    ones, so many that each partner has one of them among its own. Shingles that no other set has
    come before them in the order."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(it):
            some, sizes = [r for r in rows if r[1] == SHARED], [r for r in rows if r[1] == SIZES]
            if not some:
                continue
            o, s, df = _column(some, 2, np.int64), _column(some, 3, np.int64), _column(some, 4, np.uint16)
            order = np.lexsort((s, df, o))
            s, o = s[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            k = np.diff(np.append(first, len(o)))
            known, at = np.unique(_column(sizes, 2, np.int64), return_index=True)
            n = _column(sizes, 3, np.int64)[at][np.searchsorted(known, o[first])]
            take = np.maximum(0, k - needed(n, percent) + 1)
            kept = np.arange(len(o)) - np.repeat(first, k) < np.repeat(take, k)
            yield pa.RecordBatch.from_arrays([pa.array(o[kept]), pa.array(np.repeat(n, k)[kept]), pa.array(s[kept])], names=["digest", "n", "shingle"])

    return batches


class Lists:
    """Inverted lists of some sets: of each shingle that several have, the sets that have it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        long = np.diff(np.append(first, len(flat)))
        several = np.repeat(long > 1, long)
        self.posts, lengths = owner[several], long[long > 1]
        self.keys, self.starts = flat[first][long > 1], np.concatenate([[0], np.cumsum(lengths)])
        #: List number and set together ascend over all lists, so one search probes many lists.
        self.places = np.repeat(np.arange(len(lengths)), lengths) * self.n + self.posts

    def of(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the lists of a set's shingles, the longest first."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        return at[np.argsort(self.starts[at] - self.starts[at + 1], kind="stable")]


def merge_skip(lists: list[list[int]], threshold: int) -> Iterator[tuple[int, int]]:
    """(number, how many of the ascending lists hold it), for numbers that at least ``threshold`` hold.

    A heap merges the lists. When the least number is in too few of them, lists are taken off up to
    threshold - 1, and all of these skip to the next number on the heap: none before it can be in enough."""
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= threshold:
        least = heap[0][0]
        off = []
        while heap and heap[0][0] == least:
            off.append(heapq.heappop(heap)[1])
        if len(off) >= threshold:
            yield least, len(off)
            to = least + 1
        else:
            while heap and len(off) < threshold - 1:
                off.append(heapq.heappop(heap)[1])
            if not heap:
                return
            to = heap[0][0]
        for i in off:
            x = lists[i]
            at[i] = bisect_left(x, to, at[i])
            if at[i] < len(x):
                heapq.heappush(heap, (x[at[i]], i))


def divide_skip(lists: Lists, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are in at least ``threshold`` of the lists numbered ``at`` (the longest first), and in how many.

    The longest lists, fewer than the threshold, are put aside; the short ones are merged; a set that
    could still reach the threshold is looked up in each long list by binary search."""
    if len(at) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, posts = lists.starts, lists.posts
    # as many long lists as DivideSkip's balance of merging against probing says
    n_long = min(threshold - 1, int(threshold / (0.01 * math.log(max(2, starts[at[0] + 1] - starts[at[0]])) + 1)))
    found = list(merge_skip([posts[starts[i] : starts[i + 1]].tolist() for i in at[n_long:]], threshold - n_long))
    sets, count = np.array([f for f, _ in found], np.int64), np.array([k for _, k in found], np.int64)
    step = max(1, (1 << 22) // max(1, n_long))
    for a in range(0, len(sets) if n_long else 0, step):
        probe = (at[:n_long, None] * lists.n + sets[None, a : a + step]).ravel()
        place = np.minimum(np.searchsorted(lists.places, probe), len(lists.places) - 1)
        count[a : a + step] += (lists.places[place] == probe).reshape(n_long, -1).sum(axis=0)
    return sets[count >= threshold], count[count >= threshold]


def partners(lists: Lists, sizes: np.ndarray, sets: list[np.ndarray], q: int, percent: int) -> np.ndarray:
    """The sets that link with set q, q itself left out."""
    n = len(sets[q])
    j, overlap = divide_skip(lists, lists.of(sets[q]), needed(n, percent))  # no partner overlaps less
    return j[(j != q) & (overlap * 100 >= percent * (n + sizes[j] - overlap))]


def tree(sets: list[np.ndarray], labels: list[int], asked: list[int], percent: int, largest: int | None = None) -> Iterator[tuple[int, int]]:
    """Links among sets that join components, which ``labels`` tell at first: places of two sets each.

    The sets ``asked`` search among all. One that has got into the component of ``largest`` by then
    need not: the other end of a link of it searches too, or is in that component. Where
    ``largest`` is not given it is told after FIRST searches, once."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    lists, sizes = Lists(sets), np.array([len(s) for s in sets])
    for i, q in enumerate(asked):
        if largest is None and i == FIRST:
            most, k = Counter(root(x) for x in labels).most_common(1)[0]
            largest = most if k > 1 else None
        if largest is not None and root(labels[q]) == root(largest):
            continue
        for j in partners(lists, sizes, sets, q, percent).tolist():
            a, b = root(labels[q]), root(labels[j])
            if a != b:
                above[a] = b
                yield q, j


def _search(percent: int):
    """Parts of blocks (spot, digest, set, label, asked, largest) -> a tree of the links of each."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(it):
            rows.sort(key=lambda r: r[1])  # digests are random, so the first ones are a fair choice
            asked = [i for i, r in enumerate(rows) if r[4]]
            if len(rows) > 1 and asked:
                sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
                pairs = [(rows[q][1], rows[j][1]) for q, j in tree(sets, [r[3] for r in rows], asked, percent, rows[0][5])]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])

    return batches


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``.

    Null or empty text, or text of white space only, has no shingles and links with nothing. Rows
    without doc_id get n_shingles and a null component, and link nothing. Rows that repeat a doc_id
    each have the component of their own text. Equal sets are linked whatever their number. Other
    columns are ignored; an empty table gives an empty table. Shingles, and whole sets, are told
    apart by 64-bit hashes.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(width, -(-volume // BUCKET))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(width, "bucket").sortWithinPartitions("bucket")

    # 1: sets with enough shared reduced shingles
    packed = by_bucket(rows.mapInArrow(_pack_reduced(buckets, words, percent), PACKED))
    shared = staged(packed.mapInArrow(_shared_shingles(width), PACKED), "shared")
    info = shared.filter(F.col("kind") == DOCUMENTS).mapInArrow(_document_rows, "doc_id long, n long, digest long, alike long")
    sets = staged(info.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.max("alike").alias("alike")), "distinct-sets")
    counts = by_bucket(shared.filter(F.col("kind") == SHARED)).mapInArrow(_sum_shared, "digest long, k long")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / SHARE))
    wanted = sets.join(counts, "digest").filter(F.col("k") + F.col("alike") >= least).select(F.col("rep").alias("doc_id")).distinct()
    texts = packed_texts(rows.filter("doc_id IS NOT NULL")).join(wanted, "doc_id").select("doc_id", "packed")
    whole = staged(texts.mapInArrow(_whole_sets(words), "digest long, set binary"), "sets")

    # 2: their rarest shingles, and blocks of the sets that share one
    frequent = by_bucket(whole.mapInArrow(_pack_whole(buckets, width), PACKED)).mapInArrow(_frequencies(width), PACKED)
    rare = staged(by_bucket(frequent).mapInArrow(_rare_first(percent), "digest long, n long, shingle long"), "rare")
    centers = rare.groupBy("shingle").agg(F.min("digest").alias("center"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    # a second key computed after the grouping: both sides are exchanged, and AQE can split a hot shingle
    spot = F.xxhash64("shingle").alias("spot")
    members = rare.select("*", spot).join(centers.select("shingle", "center", spot), ["spot", "shingle"]).select("center", "digest", "n").distinct()
    members = staged(members, "members")

    # 3: each block by itself; one in parts has some sets in each, so that a group hangs together
    load = lambda k, n: F.ceil(F.greatest(F.col(k) / part, F.col(n) / (part * USUAL))).cast("int")
    own = F.xxhash64("center").alias("spot")
    pivots = [F.min_by("digest", F.xxhash64("digest", F.lit(i))) for i in range(3)]
    size = members.groupBy("center").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.array_distinct(F.array("center", *pivots)).alias("pivots"))
    size = staged(size.select("center", load("k", "total").alias("parts"), "pivots"), "blocks")
    dealt = members.select("*", own).join(size.select("center", "parts", own), ["spot", "center"]).select("center", "digest", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("p"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_each = size.filter("parts > 1").select("center", F.explode("pivots").alias("digest"), "parts").select("center", "digest", every("parts").alias("p"))
    dealt = dealt.union(in_each).distinct().select(F.concat_ws("/", "center", "p").alias("spot"), "digest", F.col("digest").alias("label"), F.lit(True).alias("asked"), F.lit(None).cast("long").alias("largest"))

    def searched(grid: DataFrame) -> DataFrame:
        placed = grid.join(whole, "digest").select("spot", "digest", "set", "label", "asked", "largest")
        return placed.repartition(width, "spot").sortWithinPartitions("spot").mapInArrow(_search(percent), "u long, v long")

    links = staged(searched(dealt), "links")
    near = components(links)

    # 4: blocks in parts, where they are not one component
    big = size.filter("parts > 1")
    if not big.isEmpty():
        block = members.select("*", own).join(big.select("center", "parts", own), ["spot", "center"]).drop("spot")
        block = block.join(near, F.col("digest") == F.col("node"), "left").select("center", "parts", "digest", "n", F.coalesce("component", "digest").alias("label"))
        block = staged(block, "large-blocks")
        split = block.groupBy("center", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).groupBy("center").agg(
            F.max_by(F.struct("label", "k", "n"), F.struct("k", "label")).alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n"))
        split = split.select("center", F.col("most.label").alias("largest"), (F.col("k") - F.col("most.k")).alias("rest_k"), (F.col("n") - F.col("most.n")).alias("rest_n"))
        split = split.filter("rest_k > 0").select("center", "largest", load("rest_k", "rest_n").alias("chunks"))
        block = block.select("*", own).join(split.select("*", own), ["spot", "center"])
        key = ["center", "digest", "label", "largest"]
        there = block.select(*key, F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("p"), every("chunks").alias("c"), F.lit(False).alias("asked"))
        asked = block.filter("label <> largest").withColumn("c", F.pmod(F.hash("digest"), F.col("chunks")).cast("int")).select(*key, every("parts").alias("p"), "c", F.lit(True).alias("asked"))
        grid = there.union(asked).groupBy(*key, "p", "c").agg(F.max("asked").alias("asked")).withColumn("spot", F.concat_ws("/", "center", "p", "c"))
        near = components(links.union(searched(grid.select("spot", "digest", "label", "asked", "largest"))))

    # the least document of each component
    named = near.join(sets, F.col("node") == F.col("digest")).select("digest", "n", "component", "rep")
    of = F.hash("component").alias("spot")
    least_of = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = named.select("*", of).join(least_of.select("*", of), ["spot", "component"]).select("digest", "n", "component_id")
    reps = sets.select("digest", "n", "rep").join(joined, ["digest", "n"], "left").select("digest", "n", F.coalesce("component_id", "rep").alias("component_id"))
    mark = F.hash("digest").alias("mark")
    out = info.select("*", mark).join(reps.select("*", mark), ["mark", "digest", "n"], "left")
    lone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), lone.alias("component_id"))


def one_per_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, all columns kept; rows without doc_id stay.

    A doc_id on several rows goes when each of its texts has a lesser partner."""
    groups = near_groups(docs, words, percent).filter("doc_id IS NOT NULL")
    gone = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") - F.col("component_id")).alias("behind")).filter("behind > 0")
    return docs.join(gone.select(F.col("doc_id").alias("_dropped")), F.col("doc_id") == F.col("_dropped"), "left_anti")
