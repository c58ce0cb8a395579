"""Many strings looked up in many texts by one pass of an Aho-Corasick automaton."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: A part of the dictionary, and so an automaton, has about so many characters.
PART_CHARS = 2_000_000


def _part_hits(texts: DataFrame, terms: DataFrame, schema: T.StructType, whole: bool) -> DataFrame:
    """Hits of one part of the dictionary, which the driver holds and sends to every task."""
    surfaces = texts.columns[1:]
    asked: dict[str, int] = {}
    for r in terms.toLocalIterator():
        if r["surface"] in surfaces:
            asked[r["term"]] = asked.get(r["term"], 0) | 1 << surfaces.index(r["surface"])
    shared = texts.sparkSession.sparkContext.broadcast(list(asked.items()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [t for t, _ in shared.value]
        machine = ahocorasick.Automaton()
        for k, (term, mask) in enumerate(shared.value):
            machine.add_word(term, (k, len(term), mask))
        if words:
            machine.make_automaton()
        for b in it:
            at, surface, term, n, alone = [], [], [], [], []
            for j, name in enumerate(surfaces if words else []):
                for i, text in enumerate(b.column(j + 1)):
                    found: dict[int, int] = {}
                    words_of: dict[int, int] = {}
                    free: dict[int, int] = {}  # where a further occurrence of a term may begin
                    text = text.as_py() or ""
                    last = len(text) - 1
                    for end, (k, size, mask) in machine.iter(text):
                        if mask >> j & 1:
                            if end - size + 1 >= free.get(k, 0):
                                found[k] = found.get(k, 0) + 1
                                free[k] = end + 1
                            if whole and (end == last or text[end + 1] == " ") and (end < size or text[end - size] == " "):
                                words_of[k] = words_of.get(k, 0) + 1
                    at += [i] * len(found)
                    surface += [name] * len(found)
                    term += [words[k] for k in found]
                    n += found.values()
                    alone += [words_of.get(k, 0) for k in found] if whole else []
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(surface, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int32()), pa.array(alone, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns[: len(schema.names)], names=schema.names)

    return texts.mapInArrow(batches, schema)


def hits(texts: DataFrame, terms: DataFrame, part_chars: int = PART_CHARS, whole: bool = False) -> DataFrame:
    """id, surface, term, n: how often a term stands in a text without overlapping itself, where it does;
    with ``whole`` also n_whole, how often it stands there between spaces or the text's ends.

    ``texts`` has an id and further columns of text, the surfaces; ``terms`` has surface and term.
    Null texts and null or empty terms hit nothing, repeated terms count once. The characters of
    all terms are counted: each part of about ``part_chars`` has an automaton of its own, and all
    texts pass through each, in tasks of their own. Nothing is shuffled but the terms. Texts may be
    a stream."""
    terms = terms.filter(F.length("term") > 0).select("surface", "term").distinct()
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    parts = max(1, math.ceil(chars / part_chars))
    schema = T.StructType([T.StructField("id", texts.schema[texts.columns[0]].dataType), T.StructField("surface", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())])
    if whole:
        schema.add("n_whole", T.IntegerType())
    found = None
    for p in range(parts):
        some = _part_hits(texts, terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == p), schema, whole)
        found = some if found is None else found.unionByName(some)
    return found
