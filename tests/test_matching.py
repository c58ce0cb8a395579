"""Keyword matching, and rules of scoring."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import automaton, digest, matching, scoring, selection
from sheaf.operators.matching import MatchConfig
from sheaf.plans.views import view
from sheaf.sources.stage import staged


def rows(df):
    return sorted(map(tuple, df.collect()))


def dictionary(spark, data, n):
    """So many distinct strings that stand in the texts, next to odd ones."""
    words = [r[0] for r in view(spark, data, "articles_raw").select(F.explode(F.split(F.lower("content"), "[^a-zà-ÿ ]+")).alias("w")).filter("length(w) BETWEEN 1 AND 30").distinct().orderBy("w").limit(n).collect()]
    return [w.strip() for w in words] + ["a", "th", "aa", "zzzz", "", None, "the", "the", "𝄞", "tion of"]


@pytest.mark.parametrize("n", [20, 2100])
def test_automaton_finds_what_python_finds(spark, data, n):
    f = matching.text_features(view(spark, data, "articles_raw")).select("id", "clean_text").union(spark.createDataFrame([("x", None), ("y", ""), ("z", "aaaaa 𝄞aaa the the")], "id string, clean_text string")).cache()
    keywords = dictionary(spark, data, n)
    d = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    texts = {r["id"]: r["clean_text"] or "" for r in f.collect()}
    expected = sorted((i, k, t.count(k)) for i, t in texts.items() for k in {k for k in keywords if k} if k in t)
    found = matching.keyword_hits(f, d)
    assert rows(found) == expected
    assert rows(matching.keyword_hits(f, d, MatchConfig(part_chars=300))) == expected  # in many parts
    assert not any(x in found._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))


def test_tokens_are_counted_in_place_and_whole(spark):
    """An article's words are counted without a shuffle; an id on several rows has them added up, as the SQL does."""
    a = spark.createDataFrame([("1", "The rain", "rain, rain of <b>Spain</b> 𝄞aaa to it"), ("2", "", None), ("3", "x", "the of to")], "id string, title string, content string")
    one = [("1", "rain", 3, 4), ("1", "spain", 1, 4)]
    got = matching.token_counts(a.withColumn("content", F.replace("content", F.lit("𝄞aaa"), F.lit(""))))
    assert rows(got) == one and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = a.union(spark.createDataFrame([("1", "Rain", "sun")], a.schema))
    assert rows(matching.token_counts(twice)) == [("1", "aaa", 1, 7), ("1", "rain", 4, 7), ("1", "spain", 1, 7), ("1", "sun", 1, 7)]
    f = matching.text_features(a.withColumn("source_feed", F.lit("f")))
    assert [r["n_tokens"] for r in f.orderBy("id").collect()] == [len(r["tokens"]) for r in f.orderBy("id").collect()] == [5, 0, 0]
    k = spark.createDataFrame([("t", 1, "rain of", "include"), ("t", 2, "the rain", "include")], "name string, kw_ord int, keyword string, kind string")
    got = matching.topic_hits(f, k).filter("id = '1'")
    assert sorted((r["keyword"], r["phrase_count"], r["word_count"]) for r in got.collect()) == [("rain", 3, 3), ("rain of", 1, 1), ("the rain", 1, 1)]


def test_narrow_stages_are_not_taken_for_small(spark):
    """Spark broadcasts what it takes for less than 10 MB; half a million equal rows are 300 KB in a compressed file."""
    df = spark.range(500_000).select(F.lit("a channel").alias("chat_id"), F.lit("a topic").alias("name"), F.lit(0.5).alias("score"))
    size = lambda x: x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(staged(df, "small")) < 1_000_000 and size(staged(df, "plain", plain=True)) > 10 << 20


def test_no_keywords_and_no_texts(spark):
    texts = spark.createDataFrame([("1", "some text")], "id string, clean_text string")
    assert rows(matching.keyword_hits(texts, spark.createDataFrame([], "keyword string"))) == []
    assert rows(matching.keyword_hits(texts.limit(0), spark.createDataFrame([("text",)], "keyword string"))) == []


def test_surfaces_have_terms_of_their_own(spark):
    texts = spark.createDataFrame([("1", "one two", "two three")], "id string, a string, b string")
    terms = spark.createDataFrame([("a", "two"), ("b", "three"), ("b", "one"), ("c", "two")], "surface string, term string")
    assert rows(automaton.hits(texts, terms)) == [("1", "a", "two", 1), ("1", "b", "three", 1)]


def test_scores_without_hits_and_with_empty_keywords(spark):
    a = spark.createDataFrame([("1", "Rain", "the rain of nations"), ("2", "Sun", None)], "id string, title string, content string")
    k = spark.createDataFrame([("t", 1, "rain of", "include"), ("t", 2, "of no one", "include"), ("u", 1, "", "include"), ("u", 2, "Sun", "include"), ("u", 3, "", "exclude")], "name string, kw_ord int, keyword string, kind string")
    pairs = spark.createDataFrame([(i, "c", n) for i in "12" for n in "tu"], "id string, chat_id string, name string")
    found = scoring.text_hits(a, k)
    got = {(r["id"], r["name"]): (r["score"], r["n_matched"], r["matched"]) for r in scoring.weighted_keywords(pairs, found, k).collect()}
    assert got == {("1", "t"): (1.0, 1, ["rain of"]), ("2", "t"): (0.0, 0, []), ("1", "u"): (0.0, 0, []), ("2", "u"): (0.1, 1, ["sun"])}
    got = {(r["id"], r["name"]): (r["relevance"], r["n_matched"]) for r in scoring.fallback(pairs, found, k).collect()}
    assert got == {("1", "t"): (0.35, 1), ("2", "t"): (0.0, 0), ("1", "u"): (0.15, 1), ("2", "u"): (0.3, 2)}


def test_phrase_inside_a_word_matches(spark):
    a = spark.createDataFrame([("1", "Rain", "The rain of AI is a train.", "f")], "id string, title string, content string, source_feed string")
    k = spark.createDataFrame([("t", 1, "ai", "include"), ("t", 2, "none", "include")], "name string, kw_ord int, keyword string, kind string")
    r = matching.relevance(matching.text_features(a), k).first()
    assert r["score"] == 0.6  # "ai" occurs four times: 1 / 2, and a bonus of 0.2 / 2


def test_low_confidence_never_occurs(spark):
    grid = spark.range(0, 11).selectExpr("id / 10 AS kw").crossJoin(spark.range(0, 4).selectExpr("id AS n")).crossJoin(spark.range(0, 11).selectExpr("id / 10 AS cq")).crossJoin(spark.range(0, 11).selectExpr("id / 10 AS uq"))
    g = grid.withColumn("rel", scoring.composite(F.col("kw"), F.col("cq"), F.col("uq"), F.lit(0.0))).withColumn("conf", scoring.confidence(F.col("kw"), F.col("n"), F.col("cq"), F.col("uq")))
    assert g.filter(scoring.route(F.col("rel"), F.col("conf")) == "low_confidence").count() == 0


def test_messages_keep_items_in_order(spark):
    rows = [("c", "t", i, f"item {i} " + "x" * 50 + "\n") for i in range(1, 8)]
    m = digest.messages(spark.createDataFrame(rows, "chat_id string, topic_name string, rank int, item string"), 150).orderBy("message_no").collect()
    assert len(m) > 1 and all(len(r["message"]) <= 150 for r in m)
    assert [w for r in m for w in r["message"].split() if w.isdigit()] == [str(i) for i in range(1, 8)]


def test_stress_topics(spark):
    """A keyword of thousands of characters, a thousand keywords, and keywords that look like patterns."""
    a = spark.createDataFrame([("1", "Load test", "This is a test of load with keyword7 and more.", "f")], "id string, title string, content string, source_feed string")
    keywords = [("long", 0, "very " * 3000 + "long"), *[("many", i, f"keyword{i}") for i in range(1000)], *[("odd", i, k) for i, k in enumerate([".*test.*", "[a-z]+\\d+", "load|test", "$", "("])]]
    k = spark.createDataFrame([(*x, "include") for x in keywords], "name string, kw_ord int, keyword string, kind string")
    f = matching.text_features(a)
    assert [(r["keyword"], r["phrase_count"]) for r in matching.topic_hits(f, k).collect()] == [("keyword7", 1)]
    got = {r["name"]: r["score"] for r in matching.relevance(f, k).collect()}
    assert set(got) == {"many"} and 0 < got["many"] < 0.1


@pytest.mark.parametrize("relevance, confidence, routing, action", [
    (0.75, 0.85, "high_confidence", "accept"), (0.25, 0.85, "low_confidence", "reject"), (0.5, 0.9, "uncertain", "model"), (0.85, 0.65, "high_confidence", "accept"), (0.75, 0.65, "uncertain", "model"),
    (0.15, 0.65, "low_confidence", "reject"), (0.3, 0.25, "definitely_irrelevant", "model"), (0.4, 0.25, "uncertain", "model"), (0.7, 0.8, "high_confidence", "accept"), (0.8, 0.6, "high_confidence", "accept"), (0.9, 0.5, "uncertain", "model"),
])
def test_routing_bands(spark, relevance, confidence, routing, action):
    r = spark.range(1).select(scoring.route(F.lit(relevance), F.lit(confidence)).alias("routing")).select("routing", scoring.action(F.col("routing"), F.lit(relevance)).alias("action")).first()
    assert tuple(r) == (routing, action)


def test_topic_search(spark):
    topics = spark.createDataFrame([("1", "Rust News", True), ("2", "Rust News", True), ("1", "Go", False), ("1", "Data", True)], "chat_id string, name string, active boolean")
    keywords = spark.createDataFrame([("Data", "Apache Spark", "include"), ("Data", "rust", "exclude"), ("Go", "golang", "include")], "name string, keyword string, kind string")
    queries = spark.createDataFrame([("RUST",), ("spark",), ("go",), ("a",), (None,), ("",)], "query string")
    got = selection.search_topics(topics, keywords, queries)
    assert rows(got) == sorted([("RUST", "1", "Rust News"), ("RUST", "2", "Rust News"), ("spark", "1", "Data"), ("a", "1", "Data"), ("", "1", "Rust News"), ("", "2", "Rust News"), ("", "1", "Data")])
