"""Examples of column functions with exact results."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as tx, words
from sheaf.operators import html
from sheaf.sources import feeds


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, expected", [
    ("[Tech] New Release", "New Release"), ("Great Story | Some Site", "Great Story"), ("Update: It works", "It works"), ("[x]", "[x]"), ("Short - Wired", "Short - Wired"),
    ("A rather long title about something important - TechCrunch", "A rather long title about something important"), ("Été: café", "café"),
    ("No marks at all", "No marks at all"), ("Brief | Place", "Brief"), ("Running fault-tolerant multi-region queues with Amazon SQS", "Running fault-tolerant multi-region queues with Amazon SQS"),
    ("Half-open and well-known multi-account patterns for on-call teams and long-lived services", "Half-open and well-known multi-account patterns for on-call teams and long-lived services"),
    ("A headline that goes on | A site whose name takes more than forty characters", "A headline that goes on"),
])
def test_clean_title(spark, raw, expected):
    assert one(spark, raw, tx.clean_title) == expected


@pytest.mark.parametrize("raw, expected", [
    ("https://a.b/c", "https://a.b/c"), ("https://a.b/c?utm_source=x", "https://a.b/c"), ("https://a.b/c?id=1&utm_medium=y&id=2&z=#t", "https://a.b/c?id=1&id=2#t"),
    ("https://a.b/c?b=1&a=2&b=3", "https://a.b/c?b=1&b=3&a=2"), ("https://a.b/c?q=a%20b~*", "https://a.b/c?q=a+b~%2A"),
    ("https://a.b", "https://a.b"), ("https://a.b/", "https://a.b/"), ("https://a.b/c#part", "https://a.b/c#part"), ("https://a.b/c?utm_medium=m&ref=r", "https://a.b/c"), ("https://a.b/c?keep=1&utm_source=s", "https://a.b/c?keep=1"),
    ("https://a.b/c?utm_campaign=t#part", "https://a.b/c#part"),
])
def test_normalize_url(spark, raw, expected):
    assert one(spark, raw, tx.normalize_url) == expected


def test_truncate_and_preview(spark):
    assert one(spark, "word " * 20, lambda c: tx.truncate(c, 40)).endswith("...")
    assert one(spark, "x" * 50, lambda c: tx.truncate(c, 20)) == "x" * 17 + "..."
    assert one(spark, "One sentence here. And " + "y" * 200, lambda c: tx.preview(c, 24)) == "One sentence here."


@pytest.mark.parametrize("raw, expected", [
    ("Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02 10:00:00"), ("2 Jan 2024 10:00:00 +0200", "2024-01-02 08:00:00"), ("2024-01-02T10:00:00Z", "2024-01-02 10:00:00"), ("soon", None), (None, None),
])
def test_dates(spark, raw, expected):
    assert one(spark, raw, lambda c: tx.stamp(feeds.parse_date(c))) == expected


def test_html_text():
    page = "<html><head><style>p{}</style></head><body><script>var t='</p>';</script><p>A &amp; B</p><!-- no --><form>x<input></form><p>and more text</p></body></html>"
    assert html.clean_text(page) == "A & B and more text"
    assert html.clean_text(None) == "" and html.clean_text("") == ""


def test_references_end_by_a_semicolon(spark):
    """As the SQL of H1, H2, H6 and S6 has it; titles of pages are cut inside of references."""
    page = "<html><head><title>of.&amp;&amp;&amp</title></head><body><p>R&amp;D &copy; &#65;&#x42; &lt;b&gt; &amp;lt; &amp, &copy2; &nosuch; &#6 & more</p></body></html>"
    expected = "of.&&&amp R&D © AB <b> &lt; &amp, &copy2; &nosuch; &#6 & more"
    assert html.clean_text(page) == html.page_text(page, ("script", "style")) == html.by_patterns(page) == expected
    pages = spark.createDataFrame([(1, "https://a.b/c", page), (2, "https://a.b/d", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.metadata(pages).collect()} == {1: expected, 2: ""}
    assert {r["page_id"]: r["title"] for r in html.page_articles(pages).collect()}[1] == "of.&&&amp"


def test_patterns_of_words_are_found_as_rlike_finds_them(spark):
    texts = ["best  practices", "best of practices", "top\t10", "stop 1x", "top ten", "a list \n of", "list of", "code sample", "an opinion", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for p in (*words.HIGH_CONTENT, *words.LOW_CONTENT, words.BAD_URL, r"a.c|b"):
        assert df.filter(~tx.has_any(F.col("x"), p).eqNullSafe(F.col("x").rlike(p))).count() == 0, p


def test_links(spark):
    rows = [(1, "https://a.b/c/d?x=1", '<a href="/e">E <b>e</b></a><a href="javascript:x()">no</a><a href="f.html" title="t">F</a><a href="//g.h/i">G</a><img src="p.png" alt="q"><img src="data:x">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r["url"], r["text"], r["title"]) for r in html.links(pages).orderBy("position").collect()] == [("https://a.b/e", "E e", ""), ("https://a.b/c/f.html", "F", "t"), ("https://g.h/i", "G", "")]
    assert [(r["src"], r["alt"]) for r in html.images(pages).collect()] == [("https://a.b/c/p.png", "q")]


def test_feed_items(spark):
    rss = "<rss><channel><title>T</title><item><title>A</title><link>https://a</link><description>d</description><enclosure url='u' type='t' length='1'/></item><item><title>B</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>X</title><entry><title>C</title><link rel='alternate' href='https://c'/><summary>s</summary></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("n", None), ("b", "no xml")], "feed_url string, payload string")
    got = {(r["feed_url"], r["position"], r["title"], r["link"]) for r in feeds.items(df).collect()}
    assert got == {("r", 0, "A", "https://a"), ("r", 1, "B", None), ("a", 0, "C", "https://c")}
    assert {r["feed_url"]: r["title"] for r in feeds.metadata(df).collect()} == {"r": "T", "a": "X", "n": "Untitled Feed", "b": "Untitled Feed"}


def test_feed_payloads_hold_whole_texts(spark, data):
    from sheaf.plans import pages

    tidy = lambda c: F.md5(F.trim(F.regexp_replace(c, r"\s+", " ")))
    want = pages.A(spark, data).select("title", tidy(F.coalesce("content", F.lit(""))).alias("body"))
    got = feeds.items(pages.payloads(spark, data)).select("title", tidy(F.coalesce("description", "summary", F.lit(""))).alias("body"))
    assert pages.A(spark, data).filter("length(content) > 400").count() > 0
    assert got.count() == want.count() and got.select("body").exceptAll(want.select("body")).count() == 0
