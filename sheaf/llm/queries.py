"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sheaf.llm import bpe, chat, extract, mixing, ngram_join, pseudo_lm, recipes, search, sorted_passes, spelling, suffix_dedup, toxicity, warc
from sheaf.llm.shared import table


def op1_main_text(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_pseudo_likelihood(spark, sf_dir):
    return pseudo_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op7_warc_zstd(spark, sf_dir):
    return warc.archive_digest(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


def op8_sorted_passes(spark, sf_dir):
    return sorted_passes.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_rmq_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark, sf_dir):
    return chat.chat_digest(chat.with_conflicts(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants_of(table(spark, sf_dir, "documents"))


#: The generated pages mark their article, and have these tags and character references in it and no other.
MAIN_TEXT = r"""SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(
  replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '</?(p|h1|br)>', ' ', 'g'),
    '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages)"""

#: All pairs of documents that share a shingle, and all that links reach.
NEAR_GROUPS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""

#: All cosines.
NEAR_VECTORS = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id"""

#: All strings of 200 bytes, in hexadecimal.
REPEATS = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS s FROM d)),
t AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT *, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, -1) AS fresh FROM t),
k AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
p AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM p),
u AS (SELECT q.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id)"""


def queries():
    return {
        "op1_main_text": op1_main_text,
        "op2_pseudo_likelihood": op2_pseudo_likelihood,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_source_mix": op5_source_mix,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_warc_zstd": op7_warc_zstd,
        "op8_sorted_passes": op8_sorted_passes,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_rmq_search": op11_rmq_search,
        "op12_chat_format": op12_chat_format,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql():
    return {
        "op1_main_text": MAIN_TEXT,
        "op3_exact_dedup": recipes.SQL,
        "op5_source_mix": mixing.SQL,
        "op6_ngram_jaccard": NEAR_GROUPS,
        "op7_warc_zstd": warc.SQL,
        "op8_sorted_passes": NEAR_VECTORS,
        "op9_suffix_dedup": REPEATS,
        "op11_rmq_search": search.SQL,
        "op12_chat_format": chat.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
