"""Feed files that are read in parts give the items of whole documents."""

import pytest
from pyspark.sql import functions as F

from sheaf.sources import feeds


def rss(name, n):
    item = lambda i: f"<item><title>t {i} &amp; é</title><link>http://x/{name}/{i}</link>\n<description><![CDATA[<p>some <b>text</b> {i}</p>]]></description><category>a</category><category>b</category><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><guid>{name}-{i}</guid><enclosure url='u{i}' type='t' length='1'/></item>"
    return f"<?xml version='1.0'?><rss version='2.0' xmlns:dc='d'><channel><title>Feed {name}</title><link>http://f/{name}</link><description>d</description><language>en</language>" + "".join(item(i) + "\n" * (i % 3) for i in range(n)) + "</channel></rss>"


def atom(name, n):
    entry = lambda i: f"<entry xml:lang='en'><title>e {i}</title><link href='http://y/{name}/{i}' rel='alternate'/><id>{name}-{i}</id><summary>s {i}</summary><published>2024-01-01T00:00:00Z</published><category term='c'/></entry>"
    return f"<feed xmlns='http://www.w3.org/2005/Atom'><title>Atom {name}</title><subtitle>s</subtitle><link href='http://y/{name}'/>" + "".join(map(entry, range(n))) + "</feed>"


@pytest.fixture
def folder(tmp_path):
    texts = {"a.xml": rss("a", 3000), "b.xml": atom("b", 2000), "c.xml": rss("c", 0), "d.xml": rss("d", 1) + rss("e", 2), "f.xml": "", "g.xml": "no feed at all", "h.xml": atom("h", 0)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path), texts


def rows(df, *drop):
    return sorted(map(repr, df.drop("feed_url", *drop).collect()))


def test_items_of_files(spark, folder):
    path, texts = folder
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        got = feeds.file_items(spark, path).cache()
        assert got.count() == 3000 + 2000 + 3 and feeds.file_parts(spark, f"{path}/a.xml", "item").rdd.getNumPartitions() > 10
        docs = [t for t in texts.values() if t and t != texts["d.xml"]] + [rss("d", 1), rss("e", 2)]
        whole = feeds.items(spark.createDataFrame([("x", t) for t in docs], "feed_url string, payload string"))
        assert rows(got, "block", "place") == rows(whole, "position")
        order = [r["guid"] for r in got.filter(F.col("feed_url").endswith("a.xml")).orderBy("block", "place").collect()]
        assert order == [f"a-{i}" for i in range(3000)]
        heads = feeds.file_metadata(spark, path)
        assert rows(heads) == rows(feeds.metadata(spark.createDataFrame([("x", t) for t in docs if t != texts["g.xml"]], "feed_url string, payload string")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
