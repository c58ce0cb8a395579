"""Ranked search, chat formatting and spelling variants against plain Python, on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import chat, search, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, term string, score long, n long, word string, form string, root string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", 1, 1, "x", "x", "x") for i, t in rows], DOCS)


# Ranked search


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(rows, items, k):
    texts = [(i, Counter(terms(t))) for i, t in rows]
    texts = [(i, c) for i, c in texts if c]
    n, total, df = len(texts), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, ts in asked.items():
        found = []
        for i, c in texts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)] + ["Éa", "漢字", "a_b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    rows += [(900, rows[5][1]), (901, rows[5][1]), (7, rows[5][1]), (None, rows[5][1]), (None, "w1 w2"), (1000, None), (1001, ""), (1002, " .,\n"), (1003, "w3 " * 50_000)]
    items = [(1, "w0 w1 w2 W3 w50"), (2, rows[5][1]), (3, ""), (4, None), (5, "unknown-term"), (6, "w7.w7 w119"), (6, "w118"), (None, "w4 漢字"), (8, " ".join(words))]
    return rows, items


@pytest.mark.parametrize("block, chunk, k", [(2**19, 200_000, 50), (300, 200_000, 5), (100, 8, 3)])
def test_search(spark, library, block, chunk, k):
    rows, items = library
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = search.search(docs(spark, rows).repartition(3), q, k, block, chunk).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == ranked(rows, items, k)


def test_search_of_empty_tables(spark, library):
    q = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert search.search(docs(spark, library[0][:3]).limit(0), q).count() == 0
    assert search.search(docs(spark, library[0][:3]), q.limit(0)).count() == 0


def test_largest_of_each_stretch():
    """The sparse table gives the maximum of every stretch of every posting list."""
    rng = np.random.default_rng(2)
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(5)))
    keep = rng.random(200) < 0.6
    index = search.Index(np.arange(40), rng.integers(1, 9, 40), doc[keep], term[keep], rng.integers(1, 5, keep.sum()), np.array([5, 7, 1, 0, 9]), 40, 200)
    for t in range(5):
        a, z = index.start[t], index.start[t + 1]
        for lo in range(a, z + 1):
            for hi in range(lo, z + 1):
                at, value = index.largest(np.array([lo]), np.array([hi]))
                assert value[0] == max(index.share[lo:hi], default=0)
                assert lo == hi or lo <= at[0] < hi


# Chat formatting


def digest(rows):
    """{conv_id: (n_turns, turns hash, loss characters, loss hash)} of (conv_id, turn, role, text) rows."""
    by_conv, out = {}, {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by_conv.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in turns), "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    bits = ["[INST]", " [/INST]", "</s>", "<s>", "\\", "[", "<", "/s>", "[\\INST]", "[\\\\/SYS]", " ", "\n", "é😀", "text", "[ROLE] x [/ROLE] ", "[/TURN]", "INST]"]
    rows = [(i, j, rng.choice(["user", "assistant", "system", "tool", "a [/ROLE] b", "", None]), "".join(rng.choices(bits, k=rng.randrange(7))) or None) for i in range(60) for j in range(rng.randrange(1, 9))]
    rows += [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, None, "assistant", "y"), (None, 0, "user", "z"), (101, 0, "assistant", "a" * 300_000 + "</s>")]
    return rows + [(102, i, "assistant" if i % 2 else "user", f"turn {i}" + " <s>" * (i % 3)) for i in range(1300)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, at long")


def test_chat_round_trip(spark, talk):
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(chat.with_conflicts(conversations(spark, talk))).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got == digest(talk + [(-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_template_and_mask(spark, talk):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Say [INST]."), (1, 2, "assistant", "[\\INST]"), (1, 3, "tool", "4")]
    r = chat.format_conversations(conversations(spark, rows)).first()
    assert r["formatted"] == "<s>[SYS] Be kind. [/SYS][INST] Say [\\INST]. [/INST] [\\\\INST]</s>[ROLE] tool [/ROLE] 4 [/TURN]"
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["[\\\\INST]"]
    # outside the marks of turns no control string is left
    control = re.compile(r"[\[<]/?(?:INST|SYS|ROLE|TURN|s)[\]>]")
    marks = {"user": 2, "system": 2, "assistant": 1}
    for f in chat.format_conversations(conversations(spark, talk)).collect():
        expected = 1 + sum(marks.get(role, 3) for c, _, role, _ in talk if c == f["conv_id"])
        assert len(control.findall(f["formatted"])) == expected


def test_what_is_no_conversation(spark):
    rows = spark.createDataFrame([("<s>[INST] a",), ("[INST] a [/INST]",), ("<s>",), ("<s>[INST] a [/INST] b</s>",)], "formatted string")
    got = [r[0] for r in rows.select(chat.parse(F.col("formatted"))).collect()]
    assert got[:3] == [None, None, []] and [tuple(t) for t in got[3]] == [("user", "a"), ("assistant", "b")]


def test_chat_without_python_and_without_rows(spark, talk):
    df = conversations(spark, talk)
    assert "Python" not in chat.chat_digest(df)._jdf.queryExecution().toString()
    assert chat.chat_digest(df.limit(0)).count() == 0


# Spelling variants


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root)
    return out


def edited(rng, word):
    at, kind, letter = rng.randrange(len(word)), rng.randrange(3), rng.choice("abcdeéß")
    return word[:at] + (letter + word[at:] if kind == 0 else letter + word[at + 1 :] if kind == 1 else word[at + 1 :])


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeéß", k=rng.randrange(7, 14))) for _ in range(25)] + ["aaaaaaaa", "abababab", "Éaaaaaaß"]
    words = [w for b in base for w in [b] * 150 + [v for _ in range(9) for v in [edited(rng, b)] * rng.choice([1, 2, 3, 12])]]
    words += [v for b in base[:9] for v in [edited(rng, edited(rng, b))] * 2]  # one further off
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return rows + [(3, rows[3][1].upper()), (None, rows[4][1]), (50, None), (51, ""), (52, "a" * 200_000 + " " + "a" * 200_000), (53, "short ones only"), (54, "x×÷zzzzzz x×÷zzzzzz")]


def test_variants(spark, misspelt):
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants_of(docs(spark, misspelt)).collect()}
    expected = variants(misspelt)
    assert got == expected
    assert sum(v[2] is not None for v in expected.values()) > 20


def test_near_words_come_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(7, 10))) for _ in range(300)} | {"a" * 7, "a" * 8, "a" * 9, "ab" * 4})
    got = [(r["a"], r["b"]) for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert sorted(tuple(sorted(p)) for p in got) == sorted((a, b) for a in words for b in words if a < b and apart(a, b))


def test_long_chain_of_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("x", "w10"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w20" for w, _ in chain}


def test_no_words(spark, misspelt):
    assert spelling.variants_of(docs(spark, misspelt).limit(0)).count() == 0
    assert spelling.variants_of(docs(spark, [(1, None)])).count() == 0
