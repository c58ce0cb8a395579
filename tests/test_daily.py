"""The funnel's figures, and daily partials that are run again."""

import os

from pyspark.sql import functions as F

from sheaf.operators import daily, matching, reports


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_one_of_twenty_keywords_does_not_pass(spark):
    a = spark.createDataFrame([("1", "Rain", "nothing but rain", "f"), ("2", "Rain", "word1 of twenty", "f")], "id string, title string, content string, source_feed string")
    k = spark.createDataFrame([("t", i, f"word{i}" if i else "rain", "include") for i in range(20)], "name string, kw_ord int, keyword string, kind string")
    topics = spark.createDataFrame([("c", "t", 1, "f")], "chat_id string, name string, topic_ord int, source_feed string")
    f = matching.text_features(a)
    got = {r["id"]: (r["score"], r["matched"]) for r in matching.prefilter(f, k, topics, matching.topic_hits(f, k)).collect()}
    assert got["1"][0] == 0.07 and not got["1"][1]  # a phrase twice and a word: 1 / 20, and 0.2 * 2 / 20; below 0.1
    assert got["2"][1]


def test_funnel_rates(spark):
    ch = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    one = lambda **c: spark.createDataFrame([("a", *c.values())], ["chat_id", *c])
    counts = {
        "fetched": one(n=100), "unique": one(n=80), "passed": one(n=20), "ready": one(n=5), "fetches": one(ok=9, all=10), "calls": one(ok=15, all=20, seconds=50), "results": one(relevant=6, all=24), "deliveries": one(sent=8, failed=2),
    }
    a, b = sorted(reports.funnel(ch, counts).collect(), key=lambda r: r["chat_id"])
    assert tuple(a) == ("a", 100, 80, 20, 5, 90.0, 20.0, 75.0, 95.0, 2.0, 75.0, 25.0, 75.0)
    assert tuple(b) == ("b", 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0)


def test_a_day_that_runs_again(spark, tmp_path):
    path = f"{tmp_path}/days"
    log = spark.range(20_000).selectExpr(
        "concat('a', id % 3000) AS article_id", "CAST(id % 4 AS STRING) AS chat_id", "(id % 100) / 100 AS ai_relevance_score",
        "CASE WHEN id % 500 <> 0 THEN timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id % 10 AS INT)) END AS processed_at", "id % 3 = 0 AS delivered", "id % 30 = 0 AS failed")
    daily.write_days(daily.day_partials(log), path)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before, total = files(), rows(daily.figures(daily.read_days(spark, path)))
    more = log.union(log.filter("date_format(processed_at, 'yyyy-MM-dd') = '2024-01-04'").limit(7))
    daily.write_days(daily.day_partials(more.filter("date_format(processed_at, 'yyyy-MM-dd') = '2024-01-04'")), path)
    assert {f for f in before ^ files()} == {f for f in before | files() if "day=2024-01-04" in f}
    merged = daily.figures(daily.read_days(spark, path))
    assert rows(merged) != total and merged.first()["results"] == 20_007
    # merging partials of partials gives what all rows give
    by_chat = daily.merged(daily.read_days(spark, path), "chat_id")
    assert rows(daily.figures(by_chat)) == rows(merged)
    assert rows(daily.figures(daily.read_days(spark, path), "day").drop("about_articles")) == rows(daily.figures(daily.day_partials(more), "day").drop("about_articles"))
    assert abs(merged.first()["about_articles"] / 3000 - 1) < 0.05
    # only the folders asked for are read
    some = daily.read_days(spark, path, "2024-01-03", "2024-01-05")
    assert {r[0].split("day=")[1][:10] for r in some.select(F.input_file_name()).distinct().collect()} == {"2024-01-03", "2024-01-04", "2024-01-05"}
    assert daily.read_days(spark, f"{tmp_path}/none").count() == 0
