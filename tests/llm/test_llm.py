"""Operators for training text: brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F, types as T

import brute
from compare import duck_rows, spark_rows
from sheaf.llm import anchors, bpe, components, extract, mixing, ngram_join, pseudo_lm, queries, recipes, sorted_passes, suffix_dedup, toxicity, warc
from sheaf.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, recipe string, shingle string, rep string, component_id string, spans string"


def docs(spark, rows):
    """Documents with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeats, near copies, a shared passage."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 70)
    rows = [(1, None, "a"), (2, "", None), (3, "  \n\t", "a"), (4, "one", "b"), (5, "ONE", "b"), (6, "one", None), (7, prose(rng, 9000), "a"), (8, "é漢😀 " * 300, "c")]
    rows += [(i, base, "a") for i in (20, 21, 22)]
    for i in range(30, 50):
        words = base.split()
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words), "b"))
    rows += [(i, prose(rng, 150) + " " + passage + " " + prose(rng, 100), "c") for i in range(60, 75)]
    rows += [(80, "a" * 500, "c"), (81, "ab" * 300, "c"), (82, passage, "c")]
    return docs(spark, rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert spark_rows(df) == duck_rows(queries.oracle_sql()[name], data, df.columns)


def test_exact_groups(spark, odd):
    rows = {r["doc_id"]: r for r in recipes.exact_groups(odd, least=16, most=64).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for i, r in rows.items():
        same = [j for j, t in texts.items() if t == texts[i]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i == max(same))
    assert rows[8]["text_sha256"] == hashlib.sha256(("é漢😀 " * 300).encode()).hexdigest()
    assert recipes.exact_groups(odd.limit(0)).count() == 0
    null_id = docs(spark, [(None, "x", "a"), (3, "x", "a"), (None, "y", "a")])
    assert sorted((r["keep_id"] or 0, r["kept"], r["group_size"]) for r in recipes.exact_groups(null_id).collect()) == [(0, False, 1), (3, False, 2), (3, True, 2)]


def test_exact_groups_where_identifiers_collide(spark, odd):
    """Identifiers by length alone: nearly all collide, and texts are told apart as such."""
    more = odd.union(docs(spark, [(None, "one", "a"), (None, "two", "a"), (6, "two", "b"), (200, "ten", "a")]))
    by_length = lambda c: F.length(c).cast("long")
    assert recipes.colliding_identifiers(more.select(F.coalesce("text", F.lit("")).alias("text")), 16, 64, by_length).count() > 5
    plain = sorted(map(str, recipes.exact_groups(more, least=16, most=64).collect()))
    assert sorted(map(str, recipes.exact_groups(more, least=16, most=64, identify=by_length).collect())) == plain
    assert sum("doc_id=6," in r for r in plain) == 2 and any("keep_id=200," in r for r in plain)


def test_without_copies(spark):
    rows = [(1, "x", "a"), (3, "x", "a"), (3, "x", "a"), (5, "y", "a"), (5, "x", "b"), (None, "x", "a"), (None, "z", "b"), (None, "z", "a"), (None, None, "c"), (None, "", "b"), (7, "q", None)]
    got = recipes.without_copies(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in got.collect()) == [(0, "", "c"), (0, "z", "a"), (5, "x", "b"), (5, "y", "a"), (7, "q", "")]
    assert recipes.without_copies(docs(spark, rows).limit(0)).count() == 0


def test_chunks_join_to_the_text(spark, odd):
    joined = odd.select("text", F.array_join(recipes.chunks(F.coalesce("text", F.lit("")), 16, 64), "").alias("j"))
    assert joined.filter("coalesce(text, '') <> j").count() == 0


def test_mix(spark, odd):
    rows = mixing.mix(odd, block_words=4, shards=4).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total, taken, target = sum(r["size"] for r in rows), {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 12 + 0.03 * target[s] for s in target), (taken, target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(3), block_words=4, shards=4).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0
    again = mixing.mixed_documents(odd, block_words=4, shards=4)
    assert again.columns == odd.columns and again.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_mix_of_null_and_repeated_ids(spark, monkeypatch):
    """Shards by the number of rows; rows that repeat an id, or have none, are documents of their own."""
    monkeypatch.setattr(mixing, "SHARDS", 2), monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = [(None if i % 7 == 0 else i // 3, "word " * (i % 50), None if i % 5 == 0 else f"s{i % 2}", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df, block_words=4).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len(t.split())) for d, t, s, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in (None, "s0", "s1"):
        some = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 8 + 0.03 * some[0]["target"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, block_words=4, shards=20).collect()))
    assert sorted(map(str, got)) != sorted(map(str, mixing.mix(df, block_words=4, shards=2).collect()))


def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = random.Random(2)
    for trial in range(3):
        weights, seats = [rng.randrange(1, 1000) for _ in range(rng.randrange(2, 30))], rng.randrange(1, 200)
        e = spark.createDataFrame([(1, i, float(w), seats) for i, w in enumerate(weights)], "g int, i int, w double, n long")
        got = {r["i"]: r["seats_won"] for r in mixing.sainte_lague(e, ["g"], "w", "n", [F.col("i")]).collect()}
        quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(weights) for k in range(seats)))[:seats]
        assert got == {i: sum(1 for _, j in quotients if j == i) for i in range(len(weights))}


def test_near_groups(spark, odd):
    expected = brute.near_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    for part in (256, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(odd, part=part).collect()}
        assert got == expected
    assert ngram_join.near_groups(odd.limit(0)).count() == 0
    null_id = docs(spark, [(None, "a b c", "a"), (4, "a b c", "a")])
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.near_groups(null_id).collect()} == {(None, None), (4, 4)}
    assert sorted(r["doc_id"] for r in ngram_join.one_per_group(odd).select("doc_id").collect()) == sorted(d for d, (_, c) in expected.items() if d == c)


def test_near_groups_in_a_loose_group(spark):
    """Documents that link with each other but mostly not with any one of them: a tree of links, not all of them."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), 3):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words), "a"))
    expected = brute.near_groups([(i, t) for i, t, _ in rows])
    sets = list(ngram_join.shingle_sets([t for _, t, _ in rows]))
    for part in (512, 16):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(docs(spark, rows), part=part).collect()} == expected
    links = list(ngram_join.tree(sets, list(range(120)), list(range(120)), 80))
    root = brute.union_find(range(120), links)
    assert len(links) == 120 - len(set(root.values())) and [root[i] for i in range(120)] == [expected[i][1] for i in range(120)]


def test_near_groups_of_a_repeated_id(spark):
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    got = ngram_join.near_groups(docs(spark, [(5, a, "a"), (5, b, "a"), (3, b, "a"), (9, a, "a"), (None, a, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 5), (9, 5)]


def test_divide_skip():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    lists = ngram_join.Lists(sets)
    for q in sets:
        overlap = [len(np.intersect1d(q, s)) for s in sets]
        for t in (1, 5, 15, len(q)):
            found, count = ngram_join.divide_skip(lists, lists.of(q), t)
            assert dict(zip(found.tolist(), count.tolist())) == {i: o for i, o in enumerate(overlap) if o >= t}
        short = [lists.posts[lists.starts[i] : lists.starts[i + 1]].tolist() for i in lists.of(q)]
        for t in (1, 3, 9):
            assert dict(ngram_join.merge_skip(short, t)) == {i: o for i, o in enumerate(overlap) if o >= t}


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = brute.union_find({x for uv in links for x in uv}, links)
    assert got == {n: root[n] for u, v in links if u != v for n in (u, v)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [16, 1])
def test_repeats(spark, odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_IN_SAMPLE", hot)
    expected = brute.repeats([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert got == {d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for d, v in expected.items()}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_of_rows_without_id(spark):
    rng = random.Random(12)
    passage, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, prose(rng, 30) + " " + passage, "a"), (None, passage, "a"), (None, other, "a"), (None, other, "a"), (None, prose(rng, 90), "a"), (None, None, "a")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect())
    size = [len((t or "").encode()) for _, t, _ in rows]
    assert got == sorted([(1, size[0], size[1]), (0, size[1], size[1]), (0, size[2], size[2]), (0, size[3], size[3]), (0, size[4], 0), (0, 0, 0)])


def test_difference_cover_sort():
    rng = np.random.default_rng(1)
    part = rng.integers(97, 99, 3000).astype(np.uint8)
    data = np.concatenate([part, part[500:1500], rng.integers(97, 99, 700).astype(np.uint8), part[700:1200]])
    at = np.arange(len(data) - 200 + 1)
    got = suffix_dedup.repeated_suffixes(data, at, np.zeros(len(at), np.int64))
    seen: dict[bytes, int] = {}
    for i in at:
        seen[data[i : i + 200].tobytes()] = seen.get(data[i : i + 200].tobytes(), 0) + 1
    assert got.tolist() == [seen[data[i : i + 200].tobytes()] > 1 for i in at]


def test_anchors_are_those_of_the_windows(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    whole = anchors.anchors(data, 200)
    monkeypatch.setattr(anchors, "SEGMENT_BITS", 10)
    parts = anchors.anchors(data, 200)
    place = lambda a: {i: int(p) for f, l, p in zip(*a) for i in range(f, l + 1)}
    assert place(whole).keys() == place(parts).keys() == set(range(4801))
    assert all(i <= p <= i + 200 - anchors.GRAM for i, p in place(parts).items())


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + (0.05 * rng.normal(size=16) if i >= 40 else 0)).tolist()) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 16), (305, [float("nan")] * 16), (306, [None] + [1.0] * 15), (307, [1e300] * 16), (308, [1e300] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, copies int, vector string")
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    root = brute.union_find([i for i, _ in rows if i is not None], links)
    degree = {i: sum(i in l for l in links) for i, _ in rows}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in sorted_passes.near_vectors(df, window=64).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (degree[i], root[i], root[i] == i) for i, _ in rows if i is not None}
    assert sorted_passes.near_vectors(df.limit(0)).count() == 0


def jittered(m, low, high, seed):
    """A vector for each row of ``m`` with a cosine from ``low`` to ``high`` to it."""
    rng = np.random.default_rng(seed)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    away = rng.normal(size=m.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(low, high, (len(m), 1))
    return (cosine * unit + np.sqrt(1 - cosine**2) * away) * rng.uniform(0.5, 2, (len(m), 1))


@pytest.mark.parametrize("window", [8, 32])
def test_recall_of_isolated_pairs(spark, window):
    """Pairs just above the threshold, in a table far larger than the window; passes are those that the table asks for."""
    base = np.random.default_rng(1).normal(size=(3000, 64))
    m = np.concatenate([base, jittered(base, 0.9501, 0.96, 2)])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    degree = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    assert degree.max() == degree.min() == 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in sorted_passes.near_vectors(df, window=window).collect()}
    found = sum(n for n, _ in got.values())
    assert found >= 0.95 * 6000 and all(n <= 1 and c == (i % 3000 if n else i) for i, (n, c) in got.items())


def test_passes_grow_with_the_table():
    passes = [sorted_passes.passes_for(10**k) for k in range(12)]
    assert passes == sorted(passes) and passes[0] == passes[6] == 16 and 16 < passes[8] < passes[10] < 60
    for k in range(6, 12):  # by arithmetic, one pair at the threshold
        one = (1 - math.acos(0.95) / math.pi) ** math.log2(10**k / 512)
        assert 1 - (1 - one) ** passes[k] >= 0.98


def test_sorted_passes_against_sql(spark, tmp_path):
    """The query's SQL on a table that has links: the driver's vectors with scaled and jittered copies."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"]]
    m = np.array([v for _, v in rows])
    more = np.concatenate([m[:40] * 3, jittered(m[:60], 0.951, 0.97, 5), jittered(m[:60], 0.94, 0.949, 6)])
    both = df.union(spark.createDataFrame([(100_000 + i, v.tolist()) for i, v in enumerate(more)], "vec_id long, embedding array<double>"))
    both.write.parquet(str(tmp_path / "embeddings.parquet"))
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        expected = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.NEAR_VECTORS})").fetchall())
    assert sum(r[1] for r in expected) >= 200
    assert sorted(map(tuple, queries.op8_sorted_passes(spark, str(tmp_path)).collect())) == expected


def test_vectors_that_share_an_id(spark):
    """One of several vectors of an id counts, the same on every run; one that can link goes before one that cannot."""
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, a), (1, b), (1, None), (2, a), (3, b), (4, None), (4, a), (None, a)]
    runs = [spark.createDataFrame(some, "vec_id long, embedding array<double>") for some in (rows, rows[::-1])]
    got = [sorted(map(str, sorted_passes.near_vectors(df).collect())) for df in runs]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    found = {(r["vec_id"], r["n_links"]) for r in sorted_passes.near_vectors(runs[0]).collect()}
    least = min((np.array(v).tobytes(), i) for v, i in ((a, "a"), (b, "b")))[1]
    assert found == ({(1, 2), (2, 2), (3, 0), (4, 2), (None, 0)} if least == "a" else {(1, 1), (2, 1), (3, 1), (4, 1), (None, 0)})


def test_links_of_large_groups_of_vectors(spark):
    """Groups larger than the window: scaled copies, tight and loose ones; every link is counted."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 64))
    rows = [base[0] * s for s in rng.uniform(0.5, 2, 700)]
    rows += [base[1] + 0.0005 * rng.normal(size=64) for _ in range(700)]
    rows += [base[2] + 0.2 * rng.normal(size=64) for _ in range(700)]
    m = np.array(rows)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    degree = ((m @ m.T) >= 0.95).sum(axis=1) - 1
    assert degree[:1400].min() == 699 and 100 < degree[1400:].mean() < 690
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in sorted_passes.near_vectors(df, window=64, tile=128).collect()}
    assert got == dict(enumerate(degree.tolist()))


def test_bpe(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {b: i for i, b in enumerate(bpe.read_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "\n\n a  b", "<|endoftext|>", "é漢😀́", "'s 'LL I'm  12 34x\t\r\n"] + ["".join(rng.choice("ab 1'\n\té漢😀 \u0085.") for _ in range(80)) for _ in range(200)] + ["word " * 50_000]
    assert [x.tolist() for x in bpe.encode_texts(texts, path, P.PATTERN)] == [enc.encode_ordinary(t) for t in texts]
    assert "".join(bpe.pieces(texts[-1])) == texts[-1]
    spans = bpe.token_spans("é漢😀", path, P.PATTERN)
    assert [s[2] for s in spans][-1] == len("é漢😀".encode()) and spans[0][3] == 0 and spans[-1][4] == 3
    enc_rows = bpe.encode(odd, path, P.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(enc_rows, path, P.PATTERN).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(back[r["doc_id"]].encode()).hexdigest() for r in bpe.round_trip(odd, path, P.PATTERN).collect())
    assert bpe.round_trip(odd.limit(0), path, P.PATTERN).count() == 0
    twice = docs(spark, [(None, "a b", "a"), (None, None, "a"), (3, "a b", "a"), (3, "a b", "a")])
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.round_trip(twice, path, P.PATTERN).collect()) == [(0, 0), (0, 2), (3, 2), (3, 2)]


def test_split_characters(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.bytes_of(bpe.spelled(bytes(range(256)))) == bytes(range(256))
    spelling, rng, seen = bpe.spellings(path, P.PATTERN), random.Random(6), 0
    for text in ["", "a", "é漢😀", "".join(chr(rng.randrange(0x3000, 0xD000)) for _ in range(300)), "plain words only"]:
        spans = bpe.token_spans(text, path, P.PATTERN)
        data = bpe.decode_ids([s[0] for s in spans], spelling)
        assert data == text.encode()
        tokens_of = [sum(1 for s in spans if s[3] <= k < s[4]) for k in range(len(text))]
        assert bpe.split_characters(data, np.array([s[2] - s[1] for s in spans], np.int64)) == sum(n > 1 for n in tokens_of)
        seen += sum(n > 1 for n in tokens_of)
        for s in spans:  # a run of tokens may end inside a character
            assert bpe.decode_ids([s[0]], spelling) == text.encode()[s[1] : s[2]]
    assert seen > 20


def test_warc(spark, tmp_path):
    big, rows = "<p>" + "x" * 300, []
    for i, h in enumerate([big, None, "", "small", "small", big, big + "é"]):
        rows.append((i + 1, f"https://a.b/{i}\r\nX: y" if i else None, h, "x", "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert [got[i]["record_type"] for i in range(1, 8)] == ["response"] * 5 + ["revisit", "response"] and got[6]["refers_to"] == 1
    assert all(got[i]["url"] == u for i, u, *_ in rows)
    assert all(bytes(got[i]["payload"]).decode() == (h or "") for i, _, h, *_ in rows if i != 6) and got[6]["payload_bytes"] == 303
    small = str(tmp_path / "s")
    warc.write_archives(pages, small, archive_bytes=900)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("part-")]) > 2
    assert sorted(map(str, warc.read_archives(spark, small).collect())) == sorted(map(str, got.values()))
    again = spark.createDataFrame([(None, "u", big), (4, "u", big), (4, "u", big), (9, "u", big)], "page_id long, url string, html string")
    warc.write_archives(again, str(tmp_path / "r"))
    rows = [(r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "r")).collect()]
    assert sorted(rows, key=str) == [(0, "revisit", 4), (4, "response", None), (4, "response", None), (9, "revisit", 4)]
    empty = str(tmp_path / "e")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


@pytest.mark.parametrize("url, uri", [("https://a.b/c%20d?e=%2F&f=g#h", "https://a.b/c%20d?e=%2F&f=g#h"), ("https://a.b/é x\r\nY: 1", "https://a.b/%C3%A9%20x%0D%0AY:%201"), ("", ""), ("100%", "100%")])
def test_target_uris(url, uri):
    raw = warc.record(1, url, b"hi", hashlib.sha256(b"hi").hexdigest(), None)
    assert f"\r\nWARC-Target-URI: {uri}\r\n".encode() in raw and warc.parse(raw)["url"] == url


def test_bad_archives():
    good = warc.record(1, "https://a.b", b"hi", hashlib.sha256(b"hi").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"hi"
    for bad in (good.replace(b"hi\r\n", b"ho\r\n"), good.replace(b"WARC/1.1", b"WORC/1.1"), good[:-2], good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(b"no frame at all"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First  para&nbsp;with <b>bo</b>ld.<p>Second<br>one.<div class="ad">Buy</div><ul><li>x</li></ul>
<script>var t = "</p>";</script></article><div id="comments"><p>Nice post!</p></div><aside>More</aside><form>Mail <input></form><footer>(c)</footer></body></html>"""


def test_extract(spark):
    expected = "A & B First para with bold. Second one. x"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", PAGE[: PAGE.index("<ul>")]), (6, "u", "<nav>only a menu</nav>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract(df).collect()}
    assert got[1] == (expected, len(expected)) and got[2] == got[3] == got[6] == ("", 0) and got[4][0] == "plain text only"
    assert got[5][0].startswith("A & B First para")
    assert extract.extract(df.limit(0)).count() == 0


PROSE = "Some words of an honest paragraph that goes on for a while and says things."


@pytest.mark.parametrize("page, expected", [
    ("<p title=it's>good text</p>", "good text"),
    ("<p>kept text here</p> <div class=\"foo", "kept text here"),
    ("<p>a < b and 3 <4</p><a href='x", "a < b and 3 <4"),
    ("<p a==b c=\"x>y\" d>one two</p>", "one two"),
    ("<article><header><h1>The title of it</h1></header><p>Some words of prose.</p></article>", "The title of it Some words of prose."),
    ("<article><p>Words of an article here.</p><figure><img><figcaption>A caption</figcaption></figure><p>More <math><mi>x</mi></math> of it.</p></article>", "Words of an article here. A caption More x of it."),
    ("<p>Press the <button>OK</button> button, then <label>wait</label>.</p><button>Share</button>", "Press the OK button, then wait."),
    ("<form><h1>A title</h1><p>A page in a form.</p></form>", "A title A page in a form."),
    ("<p>One two three four five six seven.</p><table>" + "<tr><td></td></tr>" * 60 + "</table>" + "<p>After the table come words.</p>" * 3, "One two three four five six seven." + " After the table come words." * 3),
    (f"<div class='entry related'><p>{PROSE}</p></div>", PROSE),
    (f"<article><section id='full-text-search'><p>{PROSE}</p></section></article>", PROSE),
    (f"<article><p class=comment>{PROSE}</p></article><div class=comments><p>First!</p></div>", PROSE),
    (f"<article><p>{PROSE}</p><p class='text-notice'>It matters here as well.</p><div class='social'>{PROSE}</div><div class='dialog'>She said that he had left.</div>"
     f"<ul class='menu'><li>Soup of the day</li><li>Roast beef</li></ul></article>", f"{PROSE} It matters here as well. {PROSE} She said that he had left. Soup of the day Roast beef"),
    (f"<article><p>{PROSE}</p><div class='social'>Share: <a>T</a> <a>F</a></div><div class='notice'>{PROSE}</div><ul class='menu'><li><a>Home</a><li><a>News</a></ul><div class='related'><a>{PROSE}</a></div></article>", PROSE),
    (f"<div class='article'><header><h1>The title</h1></header><p>{PROSE}</p></div><header><h2>Site</h2></header>", f"The title {PROSE}"),
    (f"<article><noscript><p>{PROSE}</p></noscript></article>", PROSE),
    ("<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(9)) + "</table>", "0 1 2 3 4 5 6 7 8"),
    ("<ul><li><a>Home</a></li><li><a>News</a></li></ul>", ""),
    (f"<div><a>Home</a> <a>News</a></div><p>{PROSE} See <a>the report</a>.</p>", f"{PROSE} See the report."),
    (f"<article><p>{PROSE}</p></article><div><p>Other words of another text.</p></div>", PROSE),
    ("<p>one<div class=ad>Buy</div>two", "one two"),
])
def test_extract_odd_pages(page, expected):
    assert extract.main_text(page) == expected


@pytest.mark.parametrize("piece", ["<a '", "<a \"", "<a b=\"", "<", "<!--", "<script>", "<p><", "</", "<div><form>", "<p class=ad>x", "&amp"])
def test_extract_hostile_pages(piece):
    import time

    page = "<p>Some words first.</p>" + piece * (1_000_000 // len(piece))
    before = time.process_time()
    assert extract.main_text(page).startswith("Some words first.")
    assert time.process_time() - before < 8


def test_extract_driver_pages(spark, data):
    import html
    import re

    pages = table(spark, data, "pages")
    got = {r["page_id"]: r["text"] for r in queries.op1_main_text(spark, data).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", body))).split())


def test_extract_unmarked_pages(spark, data):
    """Menus, footers and articles without a name of their own: learnt weights find the article, as the scan leaves the rest out."""
    import html
    import re

    pages = table(spark, data, "pages")
    weights, changed = extract.learn(pages), 0
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<(/?)(nav|footer|article)>", r"<\1div>", r["html"])
        expected = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", body))).split())
        assert extract.main_text(plain, weights) == expected
        changed += extract.main_text(plain, {"word": 1.0, "word/linked": 1.0, "tag": 0.0}) != expected
    assert changed == pages.count()


def test_extract_repeated_and_nameless_rows(spark):
    page = f"<article><p>{PROSE}</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page), (None, "v", None)], "page_id long, url string, html string")
    assert sorted(map(str, extract.extract(df).collect())) == sorted(map(str, [
        Row(page_id=1, url="u", text=PROSE, n_chars=len(PROSE))] * 2 + [Row(page_id=None, url=None, text=PROSE, n_chars=len(PROSE)), Row(page_id=None, url="v", text="", n_chars=0)]))


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity.toxicity(d, l).join(l, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.9 * sum(r["toxic"] for r in got) and hit >= 0.9 * sum(r["predicted"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20, 50)] + [(None, 1, 1), (60, 1, None), (61, 1, 1), (61, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(6)
    slot = np.full(1 << toxicity.BITS, 20, np.int32)
    slot[:20] = rng.permutation(20)
    w, v = rng.normal(size=21), rng.normal(size=(21, 3))
    w[20], v[20] = 0, 0
    m = toxicity.Machine(0.25, slot, w, v, -1.0)
    lists = [np.array(x, np.int32) for x in ([], [3], [1, 2, 5], [0, 7, 11, 100, 19], list(range(25)))]
    expected = []
    for x in lists:
        z = 0.25 + sum(w[slot[a]] for a in x) + sum(v[slot[a]] @ v[slot[b]] for i, a in enumerate(x) for b in x[:i])
        expected.append(1 / (1 + np.exp(-(z - 1.0))))
    assert np.allclose(m.score(lists), expected)


def test_machine_learns_a_pair():
    rng = random.Random(0)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insulting"] * a + ["grouping"] * b + rng.sample(WORDS, 5)))
        labels.append(float(a and b))
    lists = [toxicity.terms(t) for t in texts]
    m = toxicity.train(lists[:1000], np.array(labels[:1000]), epochs=40)
    assert (((m.score(lists[1000:]) >= 0.5) == np.array(labels[1000:])).mean()) > 0.95


def test_pseudo_likelihood(spark, odd):
    rows = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(odd).collect()}
    assert len(rows) == odd.count() and rows[1]["n_tokens"] == 0 and rows[1]["mean_log_probability"] is None and rows[7]["n_tokens"] == 9000
    assert all(r["log_likelihood"] < 0 for r in rows.values() if r["n_tokens"] > 5)
    assert pseudo_lm.pseudo_likelihood(odd.limit(0)).count() == 0


@pytest.mark.parametrize("last, words", [("Nine ", ["nine"]), (" eight \u2003 nine \n", ["eight", "nine"]), (" ", []), ("nine", ["nine"]), ("", [])])
def test_words_of_a_last_text_that_ends_by_white_space(monkeypatch, last, words):
    """Whatever bytes follow it in memory."""
    lower = pseudo_lm.pc.utf8_lower

    def followed(texts):
        low = lower(texts)
        _, offsets, data = low.buffers()
        return pa.Array.from_buffers(low.type, len(low), [None, offsets, pa.py_buffer(data.to_pybytes() + b"\x80" * 8)])

    monkeypatch.setattr(pseudo_lm.pc, "utf8_lower", followed)
    at, distinct, sizes = pseudo_lm.split(pa.array(["one two ", "", last]))
    assert [pa.array(distinct)[i].as_py() for i in at] == ["one", "two", *words] and sizes.tolist() == [2, 0, len(words)]


def ids_of(words, texts):
    """Contexts, symbols and sizes of all texts together."""
    parts = list(pseudo_lm._some(pa.array([t or "" for t in texts]), words))
    return [np.concatenate([p[i] for p in parts]) for i in range(3)]


def test_network_prefers_text_in_order(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents").filter("lang = 'en'")
    held = [r["text"] for r in d.filter("doc_id % 50 = 7").limit(60).collect()]
    rest = d.filter("doc_id % 50 <> 7")
    words = pseudo_lm.vocabulary(pseudo_lm.count_words(rest))
    net = pseudo_lm.train(rest, words)

    def mean(texts):
        context, target, _ = ids_of(words, texts)
        return pseudo_lm.log_probabilities(net, words, context, target).mean()

    rng = random.Random(1)
    assert mean(held) > mean([" ".join(rng.sample(t.split(), len(t.split()))) for t in held])


def test_network_is_trained_on_every_place(spark):
    texts = ["one two", "three", "four five six seven", None, "", " eight  Nine "]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    words = pseudo_lm.vocabulary(pseudo_lm.count_words(d))
    context, target, sizes = ids_of(words, texts)
    net, got = pseudo_lm.new_net(words), pseudo_lm.train(d, words)
    mixed = np.random.default_rng(0).permutation(len(target))
    pseudo_lm.train_on(net, words, context[mixed], target[mixed], {k: np.full_like(v, pseudo_lm.START) for k, v in net.items()})
    assert sizes.tolist() == [2, 1, 4, 0, 0, 2] and all(np.allclose(net[k], got[k], atol=1e-4) for k in net)


def small_network(spark, kinds=90):
    """A vocabulary with hashed symbols, and a network with weights of its own."""
    words = pseudo_lm.vocabulary(spark.createDataFrame([(f"w{i}", 100 - i) for i in range(kinds)], "word string, n long"), 0.8)
    net = pseudo_lm.new_net(words)
    rng = np.random.default_rng(9)
    return words, {k: (v + 0.3 * rng.normal(size=v.shape)).astype(np.float32) for k, v in net.items()}


def probability(net, words, context, symbol):
    """A forward pass in plain Python."""
    e = [x for c in context for x in net["e"][c]] + [1.0]
    h = [math.tanh(sum(e[i] * net["w"][i][k] for i in range(len(e)))) for k in range(pseudo_lm.HIDDEN)] + [1.0]
    up = lambda w: math.exp(sum(h[k] * w[k] for k in range(len(h))))
    c, own = divmod(symbol, words.span)
    first = up(net["v"][:, c]) / sum(up(net["v"][:, k]) for k in range(words.classes))
    room = min(words.span, words.size - c * words.span)
    return first * up(net["u"][c, :, own]) / sum(up(net["u"][c, :, k]) for k in range(room))


def test_network_is_that_of_plain_python(spark):
    words, net = small_network(spark)
    texts = ["w1 w2 w3 w80 w4", "w89", "w5 w88 w6 w7"]
    context, target, _ = ids_of(words, texts)
    expected = [math.log(probability(net, words, c, t)) for c, t in zip(context, target)]
    assert np.allclose(pseudo_lm.log_probabilities(net, words, context, target), expected, atol=1e-4)


def test_gradient_of_the_network(spark):
    words, net = small_network(spark)
    context, target, _ = ids_of(words, ["w1 w2 w3 w80 w4", "w5 w88 w6 w7"])
    moved, seen = {k: v.copy() for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    with np.errstate(invalid="ignore", divide="ignore"):
        pseudo_lm.train_on(moved, words, context, target, seen)
    loss = lambda n: -(pseudo_lm.log_probabilities(n, words, context, target)).mean()
    rng = np.random.default_rng(0)
    for k in net:
        for flat in rng.choice(np.flatnonzero(seen[k]), 5):
            at, far = np.unravel_index(flat, net[k].shape), {n: v.astype(np.float64) for n, v in net.items()}
            far[k][at] += 1e-3
            up = loss(far)
            far[k][at] -= 2e-3
            assert abs(abs(up - loss(far)) / 2e-3 - math.sqrt(seen[k][at])) < 2e-3


def test_network_of_large_weights_is_that_of_plain_python(spark):
    """Sums of powers that overflow single precision."""
    words, net = small_network(spark)
    net = {k: 30 * v if k in "uv" else v for k, v in net.items()}
    context, target, _ = ids_of(words, ["w1 w2 w3 w80 w4", "w89", "w5 w88 w6 w7"])
    assert pseudo_lm._most(net) > 60 and np.abs(pseudo_lm._hidden(net, context)[1] @ net["v"]).max() > 60
    expected = [math.log(probability(net, words, c, t)) for c, t in zip(context, target)]
    assert np.allclose(pseudo_lm.log_probabilities(net, words, context, target), expected, rtol=1e-4)
    large = {k: v.copy() for k, v in net.items()}
    pseudo_lm.train_on(large, words, context, target, {k: np.full_like(v, pseudo_lm.START) for k, v in net.items()}, 1e-3)
    assert all(np.isfinite(v).all() for v in large.values())
    assert pseudo_lm.log_probabilities(large, words, context, target).sum() > sum(expected)


def test_steps_of_a_network_with_a_symbol_for_each_class(spark):
    """The weights of a class with one symbol stay as they are: it is certain."""
    words = pseudo_lm.vocabulary(spark.createDataFrame([("a", 3)], "word string, n long"))
    net = pseudo_lm.new_net(words)
    context, target, _ = ids_of(words, ["a b a", "b a"])
    moved = {k: v.copy() for k, v in net.items()}
    pseudo_lm.train_on(moved, words, context, target, {k: np.full_like(v, pseudo_lm.START) for k, v in net.items()})
    assert words.span == 1 and np.allclose(moved["u"], net["u"], atol=1e-4)
    assert pseudo_lm.log_probabilities(moved, words, context, target).sum() > pseudo_lm.log_probabilities(net, words, context, target).sum()


class Counted(np.ndarray):
    """An array that counts the numbers that functions read place by place, products of matrices aside."""

    read = 0

    def __array_ufunc__(self, ufunc, method, *given, out=(), **kw):
        plain = lambda xs: [x.view(np.ndarray) if isinstance(x, Counted) else x for x in xs]
        got = getattr(ufunc, method)(*plain(given), **(kw | ({"out": tuple(plain(out))} if out else {})))
        if ufunc is not np.matmul:
            Counted.read += max(np.size(x) for x in given)
        return out[0] if out else got.view(Counted) if isinstance(got, np.ndarray) else got


def test_network_passes_over_its_powers_once(spark):
    """Of a place's powers, one for each class and one for each symbol of its class, each is taken, and then only multiplied by matrices."""
    words = pseudo_lm.Words({f"w{i}": i for i in range(2908)}, np.ones(364, np.int64), pseudo_lm.BATCH)
    weight = 1 / (np.arange(words.size) + 10)
    flat = np.random.default_rng(2).choice(words.size, words.batch, p=weight / weight.sum())
    context, powers = pseudo_lm.windows(flat, np.array([len(flat)]), words.edge), len(flat) * (words.classes + words.span)
    net = {k: v.view(Counted) for k, v in pseudo_lm.new_net(words).items()}
    Counted.read = 0
    pseudo_lm.log_probabilities(net, words, context, flat)
    assert powers < Counted.read < 1.8 * powers
    Counted.read = 0
    pseudo_lm.train_on(net, words, context, flat, {k: np.full_like(v, pseudo_lm.START) for k, v in net.items()})
    assert powers < Counted.read < 3.5 * powers


def test_probabilities_sum_to_one(spark):
    words, net = small_network(spark)
    every = [f"w{i}" for i in range(90)]
    symbols = words.of(every)
    counts = spark.createDataFrame([(f"w{i}", 100 - i) for i in range(90)], "word string, n long")
    share = {r["word"]: math.exp(r["log_share"]) for r in pseudo_lm.shares(counts, words).collect()}
    share = np.array([1.0 if w in words.ids else share[w] for w in every])
    assert len(words.ids) < 90 and len(set(symbols.tolist())) < 90
    for context in ([1, 2, 3, words.edge], [words.edge] * 4, [0, words.size - 1, 5, 7]):
        p = np.exp(pseudo_lm.log_probabilities({k: v.astype(np.float64) for k, v in net.items()}, words, np.array([context] * 90), symbols)) * share
        assert abs(p.sum() - 1) < 1e-6
    assert len(pseudo_lm.vocabulary(spark.createDataFrame([(f"w{i}", 1000) for i in range(900)], "word string, n long")).ids) > 2 * len(words.ids)


def test_scores_of_documents(spark):
    """The query's rows are sums over places in plain Python; ids are null and repeated."""
    rng = random.Random(31)
    texts = [(1, "one two three four"), (1, "one two"), (None, "Two two TWO  rare"), (None, None), (4, ""), (5, " \n one ")] + [(10 + i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=60))) for i in range(30)]
    d = docs(spark, [(i, t, "a") for i, t in texts]).coalesce(1)
    counts = Counter(w for _, t in texts for w in (t or "").lower().split())
    words = pseudo_lm.vocabulary(pseudo_lm.count_words(d))
    net, symbol_n = pseudo_lm.train(d, words), Counter()
    for w, n in counts.items():
        symbol_n[int(words.of([w])[0])] += n
    want = []
    for i, t in texts:
        ws = (t or "").lower().split()
        ids = [words.edge] * 2 + words.of(ws).tolist() + [words.edge] * 2 if ws else []
        total = sum(math.log(probability(net, words, [ids[k], ids[k + 1], ids[k + 3], ids[k + 4]], ids[k + 2]) * counts[w] / symbol_n[ids[k + 2]]) for k, w in enumerate(ws))
        want.append((i or 0, len(ws), round(total, 2)))
    got = [(r["doc_id"] or 0, r["n_tokens"], round(r["log_likelihood"], 2)) for r in pseudo_lm.pseudo_likelihood(d).collect()]
    assert len(words.ids) < len(counts)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.02 for a, b in zip(sorted(got), sorted(want))) and len(got) == len(want)


def test_scores_of_more_texts_than_one_slice(spark):
    """Each row keeps its id and has a key of its own."""
    rows = 2 * pseudo_lm.TOGETHER + 300
    d = spark.createDataFrame([(i, " ".join(["a", "b", "c", f"w{i % 90}"][: i % 5])) for i in range(rows)], "doc_id long, text string").coalesce(1)
    words = pseudo_lm.vocabulary(pseudo_lm.count_words(d))
    got = pseudo_lm.symbol_scores(d, pseudo_lm.new_net(words), words).collect()
    assert len({r["key"] for r in got}) == rows and sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, i % 5) for i in range(rows)]
    assert all((r["score"] < 0) == (r["n_tokens"] > 0) for r in got)
    far = {r["doc_id"]: sum(r["times"]) for r in got}
    assert all(far[i] == (i % 5 == 4 and f"w{i % 90}" not in words.ids) for i in range(rows) if {"a", "b", "c"} <= words.ids.keys())


def test_network_is_better_than_counting_words(spark):
    """Held-out texts: mean log-probability of a word against that by its count over all texts."""
    d = table(spark, "/root/testdata/sf0.1", "documents")
    held, rest = d.filter("doc_id % 10 = 7"), d.filter("doc_id % 10 <> 7").coalesce(1)
    counts = pseudo_lm.count_words(d).cache()
    n = {r["word"]: r["n"] for r in counts.collect()}
    words = pseudo_lm.vocabulary(counts)
    net = pseudo_lm.train(rest, words)
    scored = pseudo_lm.symbol_scores(held, net, words).cache()
    places, score = scored.agg(F.sum("n_tokens"), F.sum("score")).first()
    network = (score + pseudo_lm.with_shares(scored, counts, words).agg(F.sum("more")).first()[0]) / places
    total = sum(n.values())
    by_count = sum(math.log(n[w] / total) for r in held.collect() for w in (r["text"] or "").lower().split()) / places
    assert network > by_count + 0.3


def test_pipeline(spark, data):
    import public_tokenizers as P

    import corpus_pipeline as pipe

    docs_ = table(spark, data, "documents")
    l = table(spark, data, "labels")
    rows = {r["doc_id"]: r["text"] for r in docs_.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs_, l).collect()}
    clean = {i: t for i, t in rows.items() if scores[i] < 0.3}
    last = {}
    for i, t in clean.items():
        last[t] = max(i, last.get(t, i))
    unique = {i: clean[i] for i in last.values()}
    near = brute.near_groups(list(unique.items()))
    kept = [i for i, (_, c) in near.items() if c == i]
    step = docs_
    for name, stage in pipe.STAGES[:3]:
        step = stage(spark, step, data)
        assert step.columns == pipe.COLUMNS
    assert sorted(r["doc_id"] for r in step.collect()) == sorted(kept)
    out = pipe.run(spark, data).collect()
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(step).collect()}
    copies = {}
    for r in out:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        assert r["tokens"] == [x.tolist() for x in bpe.encode_texts([rows[r["doc_id"]]], P.path("byte_bpe_50k.tiktoken"), P.PATTERN)][0]
    assert set(copies) <= set(kept) and all(abs(copies.get(i, 0) - t / s) < 1 for i, (t, s) in taken.items() if s)


def test_pipeline_stages_on_odd_rows(spark, odd, data):
    """Nulls, repeats, clashing names and empty tables pass through every stage."""
    import corpus_pipeline as pipe

    columns = odd.columns
    more = odd.union(docs(spark, [(None, "one", "a"), (None, None, None), (20, odd.filter("doc_id = 20").first()["text"], "a")]))
    more = more.union(spark.createDataFrame([(90, "text of a row of nulls", *[None] * (len(columns) - 2))], DOCS))
    labels = table(spark, data, "labels")  # those of other documents: what the classifier learns here means nothing
    for rows in (more, odd.limit(0)):
        low = sorted((r["doc_id"] or 0) for r in toxicity.toxicity(rows, labels).collect() if r["score"] < 0.3)
        clean = pipe.drop_toxic(spark, rows, data)
        assert clean.columns == pipe.COLUMNS and sorted((r["doc_id"] or 0) for r in clean.collect()) == low
        texts = [(r["doc_id"] or 0, r["text"] or "") for r in rows.collect()]
        step, expected = rows, {r["doc_id"] for r in rows.collect()}
        for name, stage in pipe.STAGES[1:]:
            step = stage(spark, step, data).cache()
            got = {r["doc_id"] for r in step.collect()}
            assert got <= expected and (name == "byte_bpe" or step.columns == pipe.COLUMNS)
            if name == "exact_dedup":
                assert got == {max(j for j, t in texts if t == u) for _, u in texts}
            expected = got


def test_repeats_of_ids_on_several_texts(spark):
    """Each row is cut by its own text, whatever other rows its id stands on."""
    rng = random.Random(21)
    passage, long = prose(rng, 70), prose(rng, 300)
    texts = [(1, long + " " + passage), (1, "tiny"), (1, prose(rng, 260)), (2, prose(rng, 40) + " " + passage), (3, long), (3, long), (3, None), (4, passage), (None, passage + " x"), (None, long), (None, long), (None, "tiny"), (5, prose(rng, 200))]
    expected = brute.repeats(list(enumerate(t for _, t in texts)))
    want = Counter((i, *expected[k][:3], hashlib.sha256(expected[k][3]).hexdigest()) for k, (i, _) in enumerate(texts))
    got = suffix_dedup.remove_repeats(docs(spark, [(i, t, "a") for i, t in texts])).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
