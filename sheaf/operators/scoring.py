"""Scores, confidence, routing and acceptance of (article, topic) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import text as tx, words as w
from sheaf.operators import matching
from sheaf.operators.automaton import PART_CHARS, hits as find

GENERIC = sorted({x for group in w.GENERIC.values() for x in group})


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def full_text() -> Column:
    """Title, summary and content in lower case, tags kept. Articles here have no summary."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("  "), F.coalesce("content", F.lit(""))))


def plain_text() -> Column:
    """Title and content in lower case, as the fallback reads them."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))


def keyword_parts(keyword: Column) -> Column:
    return F.filter(F.split(keyword, r"\s+"), lambda x: x != "")


SURFACES = {"full": full_text, "plain": plain_text}


def text_hits(articles: DataFrame, topic_keywords: DataFrame, part_chars: int = PART_CHARS, surfaces: tuple[str, ...] = tuple(SURFACES)) -> DataFrame:
    """id, surface, term, n: keywords of topics, and parts of those of several words, in the articles.

    Surface ``full`` is for weighted keywords, ``plain`` for the fallback; each is a pass over all
    texts. Written once, it stands for the texts in all that follows."""
    included = topic_keywords.filter("kind = 'include'").select(F.lower(F.trim("keyword")).alias("term"))
    parts = included.filter(F.col("term").contains(" ")).select(F.explode(keyword_parts(F.col("term"))).alias("term"))
    terms = included.union(parts).select(F.lit("full").alias("surface"), "term").union(topic_keywords.select(F.lit("plain"), F.lower("keyword")))
    return find(articles.select("id", *[SURFACES[x]().alias(x) for x in surfaces]), terms, part_chars)


def weighted_keywords(pairs: DataFrame, found: DataFrame, topic_keywords: DataFrame, generic: list[str] = GENERIC) -> DataFrame:
    """id, chat_id, name, score, n_matched, matched (in keyword order) for (article, topic) pairs.

    ``found`` is what ``text_hits`` gives. A keyword counts once per article and topic name;
    generic ones weigh 0.3. Keywords without a hit add nothing, so only hits are joined."""
    inc = topic_keywords.filter("kind = 'include'").select("name", "kw_ord", F.lower(F.trim("keyword")).alias("keyword")).filter("keyword <> ''")
    full = found.filter("surface = 'full'").select("id", "term", "n")
    whole = inc.withColumn("term", F.col("keyword")).withColumn("n_in", F.lit(0))
    some = inc.filter(F.col("keyword").contains(" ")).withColumn("term", F.explode(keyword_parts(F.col("keyword")))).withColumn("n_in", F.lit(1))
    k = F.col("keyword")
    met = full.join(whole.union(some), "term").groupBy("id", "name", "kw_ord", "keyword").agg(F.max(F.when(F.col("n_in") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum("n_in").alias("n_in"))
    one = met.withColumn("gen", k.isin(*generic)).withColumn("multi", k.contains(" ")).withColumn("n_parts", F.size(keyword_parts(k)))
    multi, share = F.col("multi"), F.when(F.col("gen"), 0.3).otherwise(1.0)
    score = F.when(multi & (F.col("c") > 0), 0.8 * 1.5 * share).when(multi, F.col("n_in") / F.col("n_parts") * 0.4 * share).when(F.col("c") > 0, F.least(0.1 * F.col("c"), F.lit(0.6)) * share).otherwise(0.0)
    hit = (F.col("c") > 0) | (multi & (F.col("n_in") == F.col("n_parts")))
    one = one.select("id", "name", "kw_ord", "keyword", score.alias("s"), hit.alias("hit"), "gen")
    g = one.groupBy("id", "name").agg(
        F.sum("s").alias("s"), F.count_if("hit").alias("n"), F.coalesce(F.bool_or(F.col("hit") & ~F.col("gen")), F.lit(False)).alias("specific"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("kw_ord", "keyword")))), lambda x: x["keyword"]).alias("matched"))
    s = F.col("s") * F.when(F.col("n") > 1, 1.2).otherwise(1.0)
    s = s * F.when((F.col("n") > 0) & ~F.col("specific"), 0.1).otherwise(1.0)
    s = s * F.when((F.col("n") == 1) & F.col("matched")[0].isin(*w.AMBIGUOUS), 0.4).otherwise(1.0)
    theme = F.lit(1.0)
    for tests, members in reversed(w.THEMES):
        applies = F.lit(False)
        for x in tests:
            applies = applies | F.lower("name").contains(x)
        out = (F.col("n") > 0) & (F.size(F.array_intersect("matched", F.array(*[F.lit(m) for m in members]))) == 0)
        theme = F.when(applies, F.when(out, 0.3).otherwise(1.0)).otherwise(theme)
    g = g.select("id", "name", F.round(F.least(s * theme, F.lit(1.0)), 6).alias("score"), F.col("n").alias("n_matched"), "matched")
    nothing = F.array().cast("array<string>")
    return pairs.join(g, ["id", "name"], "left").select("id", "chat_id", "name", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), F.coalesce("matched", nothing).alias("matched"))


def content_quality() -> Column:
    t, n = full_text(), F.length(F.coalesce("content", F.lit("")))
    q = 0.5 + _sum([0.15 * tx.has_any(t, p).cast("int") for p in w.HIGH_CONTENT]) - _sum([0.1 * tx.has_any(t, p).cast("int") for p in w.LOW_CONTENT])
    q = q + F.when((n >= 500) & (n <= 3000), 0.1).when(n < 100, -0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 6)


def url_quality(url: Column) -> Column:
    u = F.lower(url)
    good = F.lit(False)
    for d in w.GOOD_DOMAINS:
        good = good | u.contains(d)
    path = F.when(u.contains("/docs/") | u.contains("/documentation/"), 0.2).when(u.contains("/blog/") | u.contains("/news/"), 0.1).when(u.contains("/ad/") | u.contains("/promo/"), -0.3).otherwise(0.0)
    q = 0.5 + F.when(good, 0.3).otherwise(0.0) - F.when(u.rlike(w.BAD_URL), 0.2).otherwise(0.0) + path
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 6), F.lit(0.5))


def composite(kw: Column, content_q: Column, url_q: Column, bonus: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * kw + 0.5 * content_q + 0.1 * url_q + bonus)), 6)


def confidence(kw: Column, n: Column, content_q: Column, url_q: Column) -> Column:
    k = F.when((kw > 0.8) & (n >= 2), 0.9).when((kw > 0.5) & (n >= 1), 0.7).when(kw > 0.2, 0.4).otherwise(0.1)
    c = F.when(content_q > 0.7, 0.8).when(content_q > 0.4, 0.6).otherwise(0.3)
    u = F.when(url_q > 0.7, 0.7).when(url_q > 0.4, 0.5).otherwise(0.2)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.6 * k + 0.2 * c + 0.2 * u)), 6)


def route(rel: Column, conf: Column) -> Column:
    return (
        F.when(conf >= 0.8, F.when(rel >= 0.7, "high_confidence").when(rel <= 0.3, "low_confidence").otherwise("uncertain"))
        .when(conf >= 0.6, F.when(rel >= 0.8, "high_confidence").when(rel <= 0.2, "low_confidence").otherwise("uncertain"))
        .when((conf <= 0.3) & (rel <= 0.35), "definitely_irrelevant").otherwise("uncertain")
    )


def action(routing: Column, rel: Column, block_irrelevant: bool = False) -> Column:
    """accept, reject or ask the model; only the two sure cases skip the model unless ``block_irrelevant``."""
    a = F.when((routing == "high_confidence") & (rel >= 0.7), "accept").when((routing == "low_confidence") & (rel <= 0.3), "reject")
    return (a.when(routing == "definitely_irrelevant", "reject") if block_irrelevant else a).otherwise("model")


def article_quality(articles: DataFrame) -> DataFrame:
    """id, content_q, url_q, published_at, body_hash: what routing reads of an article, in one pass over the texts."""
    return articles.select("id", content_quality().alias("content_q"), url_quality(F.col("url")).alias("url_q"), "published_at", tx.body_hash(F.col("content"), F.lit(None).cast("string")).alias("body_hash"))


def routed(weighted: DataFrame, quality: DataFrame, bonus: DataFrame | None = None) -> DataFrame:
    """Composite relevance, confidence, routing and action of pairs; ``quality``: id, content_q, url_q; ``bonus``: id, chat_id, name, bonus, or none at all."""
    j = weighted.join(quality.select("id", "content_q", "url_q"), "id")
    j = j.withColumn("bonus", F.lit(0.0)) if bonus is None else j.join(bonus, ["id", "chat_id", "name"])
    j = j.withColumn("relevance", composite(F.col("score"), F.col("content_q"), F.col("url_q"), F.col("bonus"))).withColumn("confidence", confidence(F.col("score"), F.col("n_matched"), F.col("content_q"), F.col("url_q")))
    j = j.withColumn("routing", route(F.col("relevance"), F.col("confidence")))
    return j.withColumn("action", action(F.col("routing"), F.col("relevance")))


def score_articles(articles: DataFrame, topic_keywords: DataFrame, topics: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """id, chat_id, name, relevance, confidence, routing, action of each article and active topic that match.

    Everything follows from the article and the topics as they are now, so articles can be scored
    in any batches. ``topics``: chat_id, name, topic_ord, source_feed; ``keep`` holds what is read
    more than once (a written table, or rows kept while a batch is worked on)."""
    features = keep(matching.text_features(articles).drop("tokens"))
    pairs = keep(matching.prefilter(features, topic_keywords, topics, keep(matching.topic_hits(features, topic_keywords))))
    weighted = weighted_keywords(pairs.select("id", "chat_id", "name"), keep(text_hits(articles, topic_keywords, surfaces=("full",))), topic_keywords)
    quality = keep(articles.select("id", content_quality().alias("content_q"), url_quality(F.col("url")).alias("url_q")))
    return routed(weighted, quality).select("id", "chat_id", "name", "relevance", "confidence", "routing", "action")


def fallback(pairs: DataFrame, found: DataFrame, topic_keywords: DataFrame) -> DataFrame:
    """id, chat_id, name, relevance, confidence, n_matched by the share of keywords found; null content is empty.

    ``found`` is what ``text_hits`` gives. An empty keyword is a part of every text."""
    k = topic_keywords.select("name", F.lower("keyword").alias("term"), "kind")
    empty = F.col("term") == ""
    topics = k.groupBy("name").agg(
        F.count_if(F.col("kind") == "include").alias("n"), F.count_if((F.col("kind") == "include") & empty).alias("n_empty"), F.coalesce(F.bool_or((F.col("kind") == "exclude") & empty), F.lit(False)).alias("out"))
    plain = found.filter("surface = 'plain'").select("id", "term")
    met = plain.join(k, "term").groupBy("id", "name").agg(
        F.count_if(F.col("kind") == "include").alias("n_found"), F.bool_or(F.col("kind") == "exclude").alias("found_out"))
    g = pairs.select("id", "name").distinct().join(topics, "name").join(met, ["id", "name"], "left")
    g = g.withColumn("n_matched", F.col("n_empty") + F.coalesce("n_found", F.lit(0))).withColumn("excluded", F.col("out") | F.coalesce("found_out", F.lit(False)))
    r = F.col("n_matched") / F.col("n")
    rel = F.when(F.col("excluded"), r * 0.3).otherwise(F.least(F.lit(0.8), r * 0.7))
    g = g.filter("n > 0").select("id", "name", F.round(rel, 6).alias("relevance"), F.round(F.least(F.lit(0.6), r), 6).alias("confidence"), "n_matched")
    return pairs.select("id", "chat_id", "name").join(g, ["id", "name"]).select("id", "chat_id", "name", "relevance", "confidence", "n_matched")


def generated_keywords(name: Column, most: int = 7) -> Column:
    """Keywords made up for a topic from its name."""
    low = F.lower(name)
    several = F.concat(F.array(low), F.slice(F.filter(F.split(low, r"\s+"), lambda x: x != ""), 1, most - 2), F.array(F.concat(low, F.lit(" technology"))))
    one = F.array(low, F.concat(low, F.lit(" technology")), F.concat(low, F.lit(" development")), F.concat(low, F.lit(" tools")))
    return F.slice(F.when(name.contains(" "), several).otherwise(one), 1, most)


LABELS = ("RELEVANCE_SCORE", "CONFIDENCE", "MATCHED_KEYWORDS", "REASONING")


def parsed_response(text: Column) -> dict[str, Column]:
    """Fields of a labelled model answer: the last line of a label counts, numbers are clamped to [0, 1]."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def last(label: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(f"{label}:"))
        return F.trim(F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(label) + 2)))

    number = lambda label, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(last(label).try_cast("double"), F.lit(default))))
    words = F.filter(F.transform(F.split(F.coalesce(last("MATCHED_KEYWORDS"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return {"relevance": number("RELEVANCE_SCORE", 0.0), "confidence": number("CONFIDENCE", 0.0), "keywords": F.array_join(words, ","), "reasoning": F.coalesce(last("REASONING"), F.lit(""))}


def quality_adjusted(results: DataFrame, factors: DataFrame) -> DataFrame:
    """Relevance and confidence times the provider's factor; a provider without one counts 1.

    ``factors`` has a row per provider."""
    f = F.coalesce("factor", F.lit(1.0))
    return results.join(factors, "provider", "left").withColumn("relevance", F.round(F.col("relevance") * f, 6)).withColumn("confidence", F.round(F.col("confidence") * f, 6)).drop("factor")


def ladder(calls: DataFrame, order: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Per article and topic the first success in the providers' order, else the keyword fallback.

    calls: article_id, topic_name, seq, provider, success, relevance, confidence; fallbacks: one row
    per article and topic. Of a provider's calls the latest counts."""
    ok = calls.filter("success").join(order, "provider")
    best = ok.groupBy("article_id", "topic_name").agg(F.min_by(F.struct("provider", "relevance", "confidence"), F.struct("position", -F.col("seq"))).alias("b"))
    keys = calls.select("article_id", "topic_name").union(fallbacks.select("article_id", "topic_name")).distinct()
    fb = fallbacks.select("article_id", "topic_name", F.struct(F.lit("keyword_fallback").alias("provider"), "relevance", "confidence").alias("f"))
    j = keys.join(best, ["article_id", "topic_name"], "left").join(fb, ["article_id", "topic_name"], "left")
    return j.select("article_id", "topic_name", F.coalesce("b", "f").alias("r")).filter("r IS NOT NULL").select("article_id", "topic_name", "r.*")


def combined_quality(rel: Column, conf: Column) -> Column:
    return F.round(0.7 * rel + 0.3 * conf, 6)


def accepted(routed_pairs: DataFrame, model: DataFrame, failed: DataFrame) -> DataFrame:
    """Result rows of three branches: sure pairs, pairs the model scores at least 0.5, and pairs whose
    model call raised, which keep a fallback score of at least 0.3 with a confidence of at most 0.6.

    routed_pairs: id, chat_id, name, relevance, confidence, action; model and failed: id, chat_id, name, provider, relevance, confidence."""
    cols = ["id", "chat_id", "name", "relevance", "confidence"]
    sure = routed_pairs.filter("action = 'accept'").select(*cols, F.lit("smart_routing").alias("provider"), F.lit(False).alias("summarize"))
    open_ = routed_pairs.filter("action = 'model'").select("id", "chat_id", "name")
    by_model = model.join(open_, ["id", "chat_id", "name"], "left_semi").filter("relevance >= 0.5").select(*cols, "provider", (F.col("relevance") >= 0.6).alias("summarize"))
    rescued = failed.join(open_, ["id", "chat_id", "name"], "left_semi").filter("relevance >= 0.3").select("id", "chat_id", "name", "relevance", F.least("confidence", F.lit(0.6)).alias("confidence"), F.lit("keyword_backup").alias("provider"), F.lit(False).alias("summarize"))
    return sure.union(by_model).union(rescued)
