"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector to the signs of its products with random directions, concatenated, and
orders all vectors by that hash; vectors near each other tend to share a long beginning and so to
stand near each other. Every vector is compared with its neighbours inside a window, in double
precision; the links of all passes are united to components. Then every vector is compared with its
whole component, tile by tile, and its links are counted: the window bounds the search for
components, not the number of links. Pairs are nowhere written, only a tree of each block's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sheaf.llm.components import components
from sheaf.llm.shared import shuffle_width, staged

COSINE = 0.95
#: The least number of sorted orders, neighbours compared on each side, signs in a hash.
PASSES, WINDOW, SIGNS = 16, 512, 48
#: Share of pairs at the threshold that stand near each other in some order, by which orders are added as the table grows.
RECALL = 0.98
#: Windows in a block of neighbours; only the rows of the window before it are repeated.
BLOCK = 8
#: Vectors of a component in one side of a tile, about.
TILE = 1024


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """How many orders ``n`` vectors need.

    Two vectors are neighbours of an order if they agree in its first signs, as many as cut the table
    into pieces of a window. A sign differs with probability angle / pi, so one order finds a pair with
    probability (1 - angle / pi) ** log2(n / window); orders are independent. 16 up to ten million
    vectors, 24 for 1e8, 35 for 1e9, 50 for 1e10."""
    same = 1 - math.acos(cosine) / math.pi
    found = same ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if found == 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _usable(kind: str):
    """(id, list of numbers) -> (id, bytes of ``kind``, dimension), without vectors that link with nothing."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, vectors, sizes = [], [], []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if vec_id is None or not v or any(x is None for x in v):
                    continue
                a = np.array(v, dtype=kind)
                if np.isfinite(a).all() and a.any():
                    ids.append(vec_id), vectors.append((a + a.dtype.type(0)).tobytes()), sizes.append(len(a))  # + 0: one zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "vector", "dim"])

    return batches


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision; scaled by the largest component first, so that squares stay finite."""
    m = np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _hashes(passes: int, signs: int, seed: int, kind: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.int64(1) << np.arange(signs - 1, -1, -1)).astype(np.int64)
        for b in it:
            for dim in sorted(set(b.column(2).to_pylist())):
                some = b.filter(pa.compute.equal(b.column(2), dim))
                raw = some.column(1).to_pylist()
                unit = _unit(raw, kind)
                directions = np.random.default_rng([seed, dim]).standard_normal((passes, dim, signs))
                for p in range(passes):
                    key = ((unit @ directions[p]) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(raw), p, np.int32)), pa.array(np.full(len(raw), dim, np.int32)), pa.array(key), some.column(0), some.column(1)],
                        names=["pass", "dim", "key", "vec_id", "vector"],
                    )

    return batches


def _tree(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y), as places in ids -> pairs that connect the same ids, one per linked id but the least of each component."""
    least = np.arange(len(ids))
    while True:
        now = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    at = np.nonzero(least != np.arange(len(ids)))[0]
    return ids[least[at]], ids[at]


def _by_key(of):
    """Arrow batches sorted by their first column -> the batches that ``of`` yields for the rows of each of its values."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now:
                    if rows:
                        yield from of(rows)
                    now, rows = row[0], []
                rows.append(row)
        if rows:
            yield from of(rows)

    return batches


def _compare(window: int, cosine: float, kind: str):
    """Blocks of neighbours -> a tree of their links. A block holds its own rows and those of the window before it."""

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for order in sorted({(r[3], r[4]) for r in rows}):
            some = [r for r in rows if (r[3], r[4]) == order]
            own = np.array([k for k, r in enumerate(some) if r[5]], dtype=np.int64)
            if not len(own):
                continue
            unit, at = _unit([r[2] for r in some], kind), np.array([r[6] for r in some])
            x, y = [], []
            for start in range(0, len(own), window):  # rows are in order, so all partners are among these
                part = own[start : start + window]
                low = np.searchsorted(at, at[part[0]] - window)
                i, j = np.nonzero((unit[low : part[-1] + 1] @ unit[part].T) >= cosine)
                i, j = i + low, part[j]
                gap = at[j] - at[i]
                near = (gap > 0) & (gap <= window)
                x.append(i[near]), y.append(j[near])
            u, v = _tree(np.array([r[1] for r in some]), np.concatenate(x), np.concatenate(y))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return _by_key(links)


def _count(cosine: float, kind: str):
    """Tiles of a component -> vec_id and the number of vectors it links with there. A tile holds the rows of two
    parts, or of one, whose rows are compared with each other."""

    def counts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        first = np.array([r[1] for r in rows])
        unit, copies, ids = _unit([r[3] for r in rows], kind), np.array([r[4] for r in rows], dtype=np.int64), np.array([r[2] for r in rows])
        a, b = np.nonzero(first)[0], np.nonzero(~first)[0]
        n = np.zeros(len(rows), np.int64)
        if rows[0][5]:
            linked = np.triu((unit @ unit.T) >= cosine, 1)
            n += linked @ copies + copies @ linked
        elif len(a) and len(b):
            linked = (unit[a] @ unit[b].T) >= cosine
            n[a], n[b] = linked @ copies[b], copies[a] @ linked
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], names=["rep", "n"])

    return _by_key(counts)


def _links_within(copies: DataFrame, near: DataFrame, cosine: float, tile: int, width: int, kind: str) -> DataFrame:
    """rep, others: with how many vectors of its component each vector links, copies counted.

    A component is dealt by hash into parts of about ``tile`` vectors; each pair of parts is a tile,
    so that a large component is shared out among tasks. Keys made after a grouping, as in ``components``."""
    sizes = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    spot = F.xxhash64("component").alias("spot")
    members = near.select("*", spot).join(sizes.select("*", spot), ["spot", "component"]).select(F.col("node").alias("rep"), "component", "parts")
    spot = F.hash("rep").alias("spot")
    members = members.select("*", spot).join(copies.select("rep", "vector", "copies", spot), ["spot", "rep"])
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    members = members.select("rep", "component", "vector", "copies", "parts", part.alias("part"))
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = F.struct("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    dealt = dealt.select(F.to_json(key).alias("tile"), (F.col("part") <= F.col("other")).alias("first"), "rep", "vector", "copies", (F.col("part") == F.col("other")).alias("same"))
    counted = dealt.repartition(width, "tile").sortWithinPartitions("tile").mapInArrow(_count(cosine, kind), "rep long, n long")
    return counted.groupBy("rep").agg(F.sum("n").alias("others"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, signs: int = SIGNS, seed: int = 7, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding).

    Pairs with a cosine of at least ``cosine`` are linked, none below it. Those of one component are
    all counted; a component is what the links that some pass finds connect. If ``passes`` is not
    given it follows from the number of distinct vectors (``passes_for``).
    Equal vectors are always linked, whatever their number. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. A row
    without vec_id has no links and a null component and is not kept. Rows that repeat a vec_id count
    as one vector, the least by bytes of those that can link. Other columns are ignored; an empty table gives an
    empty table.
    """
    width = shuffle_width(vectors.sparkSession)
    # vectors move as they are stored, and are made doubles where they are compared
    kind = "float32" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "float64"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = rows.mapInArrow(_usable(kind), "vec_id long, vector binary, dim int")
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("vector", "dim")).alias("v")).select("vec_id", "v.vector", "v.dim")
    usable = staged(usable, "vectors")
    copies = usable.groupBy("vector", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = staged(copies, "distinct-vectors")
    passes = passes or passes_for(copies.count(), cosine, window)

    # equal keys stand in another order in each pass
    order = ["pass", "dim", "key", "tie", "vec_id"]
    hashed = copies.select(F.col("rep").alias("vec_id"), "vector", "dim").mapInArrow(_hashes(passes, signs, seed, kind), "pass int, dim int, key long, vec_id long, vector binary").withColumn("tie", F.xxhash64("pass", "vec_id"))
    ordered = hashed.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = staged(ordered.select("pass", "dim", "vec_id", "vector", "at"), "ordered")
    # place in the whole order: rows of earlier partitions and rows before it in its own; one row per partition here
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ordered.withColumn("part", part).join(before, "part")
    placed = placed.select("pass", "dim", "vec_id", "vector", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("at"))
    block = F.floor(F.col("at") / (BLOCK * window))
    own, border = F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    last = F.col("at") % (BLOCK * window) >= (BLOCK - 1) * window
    dealt = placed.select("*", F.explode(F.when(last, F.array(own, border)).otherwise(F.array(own))).alias("b"))
    dealt = dealt.select("b.block", "vec_id", "vector", "pass", "dim", "b.own", "at")
    pairs = dealt.repartition(width, "block").sortWithinPartitions("block", "at").mapInArrow(_compare(window, cosine, kind), "u long, v long")
    pairs = staged(pairs.distinct(), "pairs")

    near = staged(components(pairs), "components")
    counted = _links_within(copies, near, cosine, tile, width, kind)
    found = copies.join(counted, "rep", "left").join(near, F.col("rep") == F.col("node"), "left")
    found = found.select("vector", "dim", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    spot = F.xxhash64("vector").alias("spot")
    of = usable.select("*", spot).join(found.select("*", spot), ["spot", "vector", "dim"]).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(of, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
