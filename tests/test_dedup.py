"""Rows that a key does not reach stay."""

from sheaf.operators import dedup


def test_null_titles_and_urls_stay(spark):
    rows = [(1, "A title of some words", "https://a.b/1", "text " * 20), (2, None, "https://a.b/2", "text " * 20), (3, "A title of some words", None, "text " * 20), (4, None, None, None),
            (5, "A title of some words", "https://a.b/1", "text " * 20), (6, None, "https://a.b/2", "text " * 20)]
    a = spark.createDataFrame(rows, "seq long, title string, url string, content string")
    got = {r["seq"]: (r["is_duplicate"], r["duplicate_of"], list(r["issues"])) for r in dedup.batch_duplicates(a).collect()}
    plain = (False, None, [])
    assert got == {1: plain, 2: plain, 3: plain, 4: plain, 5: (True, "https://a.b/1", ["Duplicate content hash", "Duplicate URL"]), 6: (True, "https://a.b/2", ["Duplicate URL"])}
