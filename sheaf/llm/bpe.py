"""Byte-level BPE encoding and decoding: the ``tokenizers`` library over Arrow batches.

A rank file gives the byte strings of the vocabulary in merge order; the model of the library is
built from it. Byte-level BPE works on 256 stand-in characters, one a byte; the table between the
two gives byte offsets on encoding and the bytes back on decoding, also where a character's bytes
are split over tokens.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sheaf.llm.shared import text_or_empty

#: Distinct pieces of text whose ids a Python worker remembers, and the longest of them; when full it
#: starts afresh.
REMEMBERED, SHORT = 250_000, 64
#: Characters of text looked at together, and given to the library as one.
AT_ONCE, JOINED = 1 << 20, 1 << 14
#: White space before a space: how it is split depends on what follows.
UNSAFE = re.compile(r"\s ")
SAFE_CUT = re.compile(r"(?<=\S)(?= )")


def byte_characters() -> list[str]:
    """The stand-in character of each byte: itself where printable, else from U+0100 upwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


CHARACTERS = byte_characters()


def byte_table() -> np.ndarray:
    """The reverse: the byte of each stand-in character, by code point."""
    table = np.zeros(1 + max(map(ord, CHARACTERS)), np.uint8)
    for byte, char in enumerate(CHARACTERS):
        table[ord(char)] = byte
    return table


BYTE_OF = byte_table()


def spelled(token: bytes) -> str:
    """A token in stand-in characters, as the library spells it."""
    return "".join(map(CHARACTERS.__getitem__, token))


def bytes_of(spelling: str) -> bytes:
    """The bytes of stand-in characters, each of which is one code unit of UTF-16."""
    return BYTE_OF[np.frombuffer(spelling.encode("utf-16-le"), np.uint16)].tobytes()


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    table = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


def merges_of(table: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For each longer token, the two earlier tokens that merging by rank joins last."""
    rank = {t: i for i, t in enumerate(table) if t}
    merges = []
    for i, token in enumerate(table):
        if len(token) < 2:
            continue
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], i))
            if rank.get(parts[best] + parts[best + 1], i) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2:
            raise ValueError(f"token {i} is not the merge of two earlier ones")
        merges.append((parts[0], parts[1]))
    return merges


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file, with its table of byte strings. Once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = read_ranks(path)
    model = models.BPE({spelled(t): i for i, t in enumerate(table) if t}, [(spelled(a), spelled(b)) for a, b in merges_of(table)])
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tok, table


def pieces(text: str) -> list[str]:
    """``text`` cut before every space that follows anything but white space; joined, the pieces
    are the text.

    The pattern's matches never reach over such a place: a match is white space only, or a space at
    most and then none. So the pieces' ids are the text's ids, whatever stands before or after."""
    if UNSAFE.search(text):
        return SAFE_CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


class Encoder:
    """Ids of texts by the ids of their pieces; each distinct piece goes to the library once in a while.

    Pieces that begin with a space and don't end with white space are encoded joined, as in a text;
    the bytes of the tokens tell where each piece ends."""

    def __init__(self, path: str, pattern: str):
        self.tok, self.table = tokenizer(path, pattern)
        self.size = np.array([len(t) for t in self.table], dtype=np.int64)
        self.ids: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        joined = [p for p in new if p[:1] == " " and not p[-1].isspace()]
        groups, held = [[]], 0
        for p in joined:
            groups[-1].append(p)
            held += len(p)
            if held > JOINED:
                groups.append([])
                held = 0
        groups = [g for g in groups if g]
        alone = [p for p in new if p and (p[0] != " " or p[-1].isspace())]
        batch = self.tok.encode_batch_fast(["".join(g) for g in groups] + alone, add_special_tokens=False)
        for g, e in zip(groups, batch):
            ids = np.array(e.ids, dtype=np.int32)
            cut = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in g])) + 1
            start = 0
            for p, end in zip(g, cut.tolist()):
                self.ids[p] = ids[start:end].tobytes()
                start = end
        for p, e in zip(alone, batch[len(groups):]):
            self.ids[p] = np.array(e.ids, dtype=np.int32).tobytes()
        self.ids[""] = b""

    def some(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts = [pieces(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = set(chain.from_iterable(parts)).difference(self.ids)
        if new:
            self.learn(list(new))
        known = self.ids.__getitem__
        for p in parts:
            yield np.frombuffer(b"".join(map(known, p)), dtype=np.int32)
        for p in new:
            if len(p) > SHORT:
                del self.ids[p]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        todo, held = [], 0
        for text in texts:
            todo.append(text)
            held += len(text)
            if held >= AT_ONCE:
                yield from self.some(todo)
                todo, held = [], 0
        yield from self.some(todo)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text, in order."""
    return encoder(path, pattern)(texts)


def token_spans(text: str, path: str, pattern: str) -> list[tuple[int, int, int, int, int]]:
    """(id, first byte, end byte, first character, end character) of each token of a text.

    A character whose bytes are split over tokens belongs to the character span of each of them."""
    _, table = tokenizer(path, pattern)
    starts = np.cumsum([0, *(len(c.encode()) for c in text)])
    at, out = 0, []
    for i in next(encode_texts([text], path, pattern)):
        end = at + len(table[i])
        first = int(np.searchsorted(starts, at, "right")) - 1
        out.append((int(i), at, end, first, int(np.searchsorted(starts, end, "left"))))
        at = end
    return out


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``carry``, tokens array<int> per row of ``docs``; null text counts as
    empty and has no tokens.

    No special tokens: their spelling in a text is ordinary text. Other columns are ignored;
    repeated rows are encoded each; an empty table gives an empty table."""
    rows = docs.select("doc_id", *(carry or []), text_or_empty().alias("text"))
    names = [*rows.columns[:-1], "tokens"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                ids = list(encode_texts(some.column(some.num_columns - 1).to_pylist(), path, pattern))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return rows.mapInArrow(batches, rows.drop("text").schema.add("tokens", T.ArrayType(T.IntegerType())))


@lru_cache(maxsize=2)
def spellings(path: str, pattern: str) -> list[str]:
    """The vocabulary by id, in stand-in characters. Once a process."""
    tok, table = tokenizer(path, pattern)
    return [tok.id_to_token(i) or "" for i in range(len(table))]


def decode_ids(ids: list[int], spelling: list[str]) -> bytes:
    """The bytes of a run of tokens: their stand-in characters by the reversed byte table."""
    return bytes_of("".join(map(spelling.__getitem__, ids)))


def split_characters(data: bytes, sizes: np.ndarray) -> int:
    """How many characters of UTF-8 text have bytes in two or more tokens, which are ``sizes`` bytes long."""
    units = np.frombuffer(data, np.uint8)
    inside = (units & 0xC0) == 0x80  # neither the first byte of a character nor a character of one byte
    cut = np.cumsum(sizes)[:-1]
    cut = cut[inside[cut]]
    return len(np.unique(np.cumsum(~inside)[cut])) if len(cut) else 0


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary per row of doc_id, tokens; null tokens count as none.

    Bytes rather than a string: a run of tokens may end inside a character."""

    def batches(it):
        spelling = spellings(path, pattern)
        for b in it:
            out = [decode_ids(x, spelling) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    rows = tokens.select("doc_id", "tokens")
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split: texts are encoded and their ids decoded in
    one pass, so that token lists leave no task. n_split: characters whose bytes are in several tokens.

    Null text counts as empty, with no tokens; repeated rows, and rows without doc_id, are encoded
    each. Other columns are ignored; an empty table gives an empty table."""

    def batches(it):
        spelling, size = spellings(path, pattern), encoder(path, pattern).size
        digits = [b"%d" % i for i in range(len(spelling))]
        for b in it:
            n, ids_sha, bytes_sha, split = [], [], [], []
            for ids in encode_texts(b.column(1).to_pylist(), path, pattern):
                own = ids.tolist()
                n.append(len(own))
                ids_sha.append(hashlib.sha256(b" ".join(map(digits.__getitem__, own))).hexdigest())
                data = decode_ids(own, spelling)
                bytes_sha.append(hashlib.sha256(data).hexdigest())
                split.append(split_characters(data, size[ids]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string()), pa.array(split, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"],
            )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
