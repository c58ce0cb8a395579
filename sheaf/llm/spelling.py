"""Grouping of spelling variants by asymmetric q-chunks.

Of two words one edit apart, the longer one (or either, at equal length) is cut into two disjoint
chunks of half its length; one edit leaves one of them whole, so it is a positional gram of the
other word, at the same place or one to the left. Chunks of common words are shared by many, so a
chunk goes on with the part of the remainder that the edit leaves alone, before or behind it: groups
are then words that agree in three quarters. Pairs that meet are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.llm.shared import staged, text_or_empty

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """Only A-Z lower-cased; plain words by the faster function."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def mistyped(doc_id: Column, run: Column, one_in: int) -> Column:
    """``run`` without one code point where the crc32 of ``doc_id:run`` is a multiple of ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least: int = 7, least_n: int = 2, one_in: int | None = None) -> DataFrame:
    """word, n: runs of letters of at least ``least`` code points and how often they stand in all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    run = lower_ascii(F.col("run"))
    word = run if one_in is None else mistyped(F.col("doc_id"), run, one_in)
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _places(length: Column):
    """For each of the four ways: where the chunk begins, and the quarter (begin, end) that the edit is in."""
    q = F.floor(length / 2).cast("int")
    head, first = F.floor((length - q) / 2).cast("int"), F.floor(q / 2).cast("int")
    zero = F.lit(0)
    return q, [(zero, q + head, length), (zero, q, q + head), (q, first, q), (q, zero, first)]


def _key(word: Column, length: Column, way: int, shift: Column, size: Column) -> Column:
    """Hash of the gram of ``word`` that stands for a chunk of a word of ``length``, and of what the edit leaves alone.

    ``shift`` is how many code points ``word`` is shorter: a gram behind the edit stands so much
    further left."""
    q, places = _places(length)
    at, begin, end = places[way]
    cut = lambda a, z: F.substring(word, a + 1, z - a)
    gram = cut(at, at + q) if way < 2 else cut(at - shift, at - shift + q)
    rest = [cut(q, begin), cut(end - shift, size)] if way < 2 else [cut(F.lit(0), begin), cut(end - shift, q - shift), cut(2 * q - shift, size)]
    return F.xxhash64(F.lit(way), length, gram, *rest)


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words that differ by one code point, once; ``words`` has distinct words, n.

    ``a`` is the longer word, or the first of two of equal length. A pair is taken where its edit is:
    in the quarter that holds the first difference, so no pair comes twice."""
    size = F.length("word")
    ways = range(4)
    chunks = words.withColumn("size", size).select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("length"),
        F.explode(F.array(*[F.struct(F.lit(w).alias("way"), _key(F.col("word"), F.col("size"), w, F.lit(0), F.col("size")).alias("key")) for w in ways])).alias("chunk"),
    ).select("a", "n_a", "length", "chunk.way", "chunk.key")
    grams = words.withColumn("size", size).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("length", F.col("size") + F.col("shift"))
    grams = grams.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), "shift",
        F.explode(F.array(*[_key(F.col("word"), F.col("length"), w, F.col("shift"), F.col("size")) for w in ways])).alias("key"),
    )
    _, places = _places(F.col("length"))
    pick = lambda part: F.element_at(F.array(*[p[part] for p in places]), F.col("way") + 1)
    begin, end = pick(1), pick(2)
    upto = lambda word, z: F.substring(word, F.lit(1), z)
    here = (upto(F.col("a"), begin) == upto(F.col("b"), begin)) & (upto(F.col("a"), end) != upto(F.col("b"), end))
    met = chunks.join(grams, "key").filter((F.length("b") + F.col("shift") == F.col("length")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b"))))
    return met.filter(here & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word end; ``forms`` has word, form of the words that have one, without a circle.

    Each round doubles how many forms are followed; the rows of a round are written and read again."""
    now, moved = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots"), 1
    while moved:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        now = staged(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        moved = now.filter("moved").limit(1).count()
    return now.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per row of ``words`` (distinct words of at least 4 code points, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n, the first in code-point order of equal ones, if that n is at least
    ``ratio`` (over 1) times its own, else null, with form_n; ``root`` is where its forms end, the
    word itself if it has none. An empty table gives an empty table."""
    words = staged(words.select("word", "n"), "words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    forms = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(forms.filter("form IS NOT NULL"))
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_of(docs: DataFrame, least: int = 7, least_n: int = 2, ratio: int = 10, one_in: int | None = 31) -> DataFrame:
    """Spelling groups of the words of all whole texts of ``docs``.

    A null text has no words; a null doc_id stands as the empty string in the hash by which one run
    in ``one_in`` is mistyped (None: texts as they are); rows that repeat a doc_id count as often as
    they stand. Other columns are ignored."""
    return spelling_groups(word_counts(docs, least, least_n, one_in), ratio)


SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
hashed(doc_id, run, n, x, pos, h) AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), 0, 4294967295 FROM runs UNION ALL
  SELECT doc_id, run, n, x, pos + 1, xor(h >> 8, crc.c) FROM hashed JOIN crc ON crc.i = xor(h, ('0x' || substr(x, 2 * pos + 1, 2))::BIGINT) & 255 WHERE 2 * pos < length(x)),
typed AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM (SELECT run, n, xor(h, 4294967295) AS h FROM hashed WHERE 2 * pos = length(x))),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.short = b.short AND a.p = b.p AND a.word <> b.word UNION
  SELECT less.word, short FROM less JOIN w v ON v.word = short UNION
  SELECT short, less.word FROM less JOIN w v ON v.word = short),
best AS (SELECT near.word, count(*) AS n_near, min({'less': -v.n, 'near': near.near}) AS b FROM near JOIN w v ON v.word = near.near GROUP BY near.word),
form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.near END AS form, CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
up(word, pos) AS (SELECT word, form FROM form WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN form f ON f.word = up.pos WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(u.pos, f.word) AS root FROM form f
LEFT JOIN (SELECT up.word, up.pos FROM up JOIN form e ON e.word = up.pos WHERE e.form IS NULL) u ON u.word = f.word
"""
