"""Column functions over titles, texts and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Titles of well-known sites that follow a dash (fixed values).
SITES = (
    "TechCrunch|Wired|Ars Technica|The Verge|Engadget|Gizmodo|Mashable|ZDNet|CNET|VentureBeat|ReadWrite|TechRadar",
    "AWS|Amazon Web Services|Microsoft|Google|Apple|IBM|Oracle|Red Hat|VMware",
    "Blog|News|Website|Site|Portal|Magazine|Daily|Weekly|Times|Post|Herald",
)
#: Query parameters that only track (fixed values).
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referer", "source", "campaign", "medium",
    "fbclid", "gclid", "dclid", "_ga", "_gl",
)
#: Endings of feed URLs and parts of URLs that are never fetched (fixed values).
FEED_URL = r"\.rss$|\.xml$|\.atom$|/rss/?$|/feed/?$|/feeds/?$|/atom/?$|/rss\.xml$|/feed\.xml$"
SUSPICIOUS_URL = r"javascript:|data:|file:|ftp:|localhost|127\.0\.0\.1|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+"

SPACE = r"[\s\x0B\x{00A0}]+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def has_any(c: Column, pattern: str) -> Column:
    """``c.rlike(pattern)`` for a pattern of alternatives. Words are looked up as parts of the text, and a
    pattern is tried only where its longest word is; others than words with white space or numbers are tried as they are."""
    if not re.fullmatch(r"(?:[a-z]|\\[sd]\+)+(?:\|(?:[a-z]|\\[sd]\+)+)*", pattern):
        return c.rlike(pattern)
    found = None
    for one in pattern.split("|"):
        longest = max(re.split(r"\\[sd]\+", one), key=len)
        has = c.contains(longest) if longest == one else c.contains(longest) & c.rlike(one)
        found = has if found is None else found | has
    return found


def sanitize(c: Column) -> Column:
    return collapse(F.regexp_replace(c, CONTROL, ""))


def clean_valid(c: Column, most: int = 6000) -> Column:
    """Whether cleaned text is worth keeping: long enough, not mostly blank, not overlong."""
    n = F.length(c)
    return F.coalesce((n >= 10) & (F.length(F.regexp_replace(c, SPACE, "")) / n >= 0.1) & (n <= most), F.lit(False))


def clean_title(c: Column) -> Column:
    """Without a [category], a ``| site`` ending, a ``word:`` beginning, and, in long titles, a site after a dash."""
    t = F.trim(F.regexp_replace(c, r"^\[.*?\]\s*", ""))
    t = F.trim(F.regexp_replace(t, r"\s*\|\s*.*$", ""))
    t = F.trim(F.regexp_replace(t, r"^[\p{L}\p{N}_]+:\s*", ""))
    for names in SITES:
        t = F.when(F.length(t) > 40, F.trim(F.regexp_replace(t, rf"(?i)\s*-\s*({names}).*$", ""))).otherwise(t)
    return F.when(t == "", c).otherwise(t)


def last_index(c: Column, one: str) -> Column:
    """Position of the last ``one`` character, from 0; -1 if there is none."""
    at = F.instr(F.reverse(c), one)
    return F.when(at > 0, F.length(c) - at).otherwise(F.lit(-1))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word in the second half where there is one."""
    space = last_index(F.substring(c, 1, most - 3), " ")
    short = F.concat(F.substring(c, 1, most - 3), F.lit("..."))
    cut = F.when(space > most // 2, F.concat(F.substring(c, F.lit(1), space), F.lit("..."))).otherwise(short) if most > 10 else short
    return F.when(F.length(c) <= most, c).otherwise(cut)


def preview(c: Column, most: int = 150, ceiling: int = 700, threshold: float = 0.7) -> Column:
    """The beginning of a text up to a sentence end, or cut with an ellipsis."""
    most = min(most, ceiling)
    t = collapse(c)
    head = F.substring(t, 1, most)
    end = F.greatest(last_index(head, "."), last_index(head, "!"), last_index(head, "?"))
    cut = F.when(end > most * threshold, F.substring(t, F.lit(1), end + 1)).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))
    return F.coalesce(F.when(F.length(t) <= most, t).otherwise(cut), F.lit(""))


def source_name(url: Column) -> Column:
    host = F.regexp_extract(url, r"https?://([^/]+)", 1)
    label = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")[0]
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("Unknown Source")).otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substr(label, F.lit(2)))))


def extractive_summary(content: Column, title: Column, sentences: int = 3) -> Column:
    """The first sentences of a text, or its title."""
    found = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, sentences), ". "), F.lit("."))).otherwise(title)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def normalize_url(url: Column) -> Column:
    """Without tracking parameters and blank values; equal keys stand together in the order first seen.

    URLs without a query stay as they are."""
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    body = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(body, r"^[^?]*\?(.*)$", 1)
    base = F.regexp_replace(F.regexp_extract(body, r"^([^?]*)", 1), r";[^/;]*$", "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pair = lambda p: F.struct(decode(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"), decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=.")), pair)
    pairs = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"])))))
    rest = F.array_join(grouped, "&")
    return F.when(query == "", url).otherwise(F.concat(base, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("?"), rest)), fragment))


def url_problem(url: Column) -> Column:
    """Why a URL is not accepted; null if it is."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (
        F.when(F.coalesce(u, F.lit("")) == "", "required")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]+)", 1) == "", "host")
        .when(F.lower(u).rlike(SUSPICIOUS_URL), "suspicious")
    )


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, a path of at least a slash, no fragment; null for a URL that is not accepted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^([A-Za-z]+://[^/?]+)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z]+://[^/?]+(.*)$", 1)
    return F.when(url_problem(url).isNull(), F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def content_hash(title: Column, url: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("|"), url), 256)


def body_hash(content: Column, summary: Column) -> Column:
    return F.md5(F.coalesce(F.nullif(content, F.lit("")), F.nullif(summary, F.lit("")), F.lit("")))


def stamp(c: Column) -> Column:
    """A timestamp as text, for results that are compared."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
