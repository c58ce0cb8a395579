"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get targets in words; the targets are turned into whole blocks by highest quotients
``target / (2k + 1)``; the blocks of a source are dealt to its shards by the same rule; and in each
shard a seeded permutation says which blocks are taken once more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheaf.llm.shared import WORD, staged

#: Coprime to any number of blocks below it, so that ``j * STRIDE + offset`` permutes the blocks.
STRIDE = 2147483647
#: The least number of shards of a source, and how many rows of the table stand for one shard.
SHARDS, SHARD_ROWS = 128, 65536


def seeded(seed: str, *parts: Column) -> Column:
    """32 bits of md5 over the seed and the parts, null as an empty string."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, epochs: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size -> and target. Sources by code point, null last, take the weights in turn.

    Water filling: a target stops at ``most`` times its source's size and what is over is shared
    again by weight. One row per source, so the windows without a key see a few rows."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sources.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(epochs)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("at", F.row_number().over(fill))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("at"))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def sainte_lague(entities: DataFrame, group: list[str], weight: str, seats: str, tie: list[Column]) -> DataFrame:
    """Adds ``seats_won``: the ``seats`` of each group go to the highest quotients weight / (2k + 1).

    With n entities and N seats the divisor of the method lies between W / (N + n/2) and
    W / (N - n/2), so an entity is sure of its lowest count under these bounds and only the few
    quotients up to its highest count compete: about four rows per entity, never one per seat."""
    g = Window.partitionBy(*group)
    e = entities.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_w", F.sum(weight).over(g))
    share = F.when((F.col("_w") > 0) & (F.col(seats) > 0), F.col(seats) * F.col(weight) / F.col("_w")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0))
    e = e.withColumn("_lo", F.greatest(F.lit(0), F.floor(share * (1 - slack) - 0.5)).cast("long"))
    e = e.withColumn("_hi", F.when(F.col(seats) > 0, F.ceil(share * (1 + slack) + 0.5) + 1).otherwise(F.lit(0)).cast("long"))
    e = e.withColumn("_rest", F.col(seats) - F.sum("_lo").over(g))
    c = e.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1))))
    c = c.withColumn("_q", F.when(F.col(weight) > 0, F.col(weight) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0)))
    rank = F.row_number().over(g.orderBy(F.desc("_q"), *tie, "_k"))
    c = c.withColumn("_won", ((rank <= F.col("_rest")) & (F.col("_q") > 0)).cast("long"))
    return c.groupBy(*entities.columns, "_lo").agg(F.sum("_won").alias("_won")).withColumn("seats_won", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop("_lo", "_won")


def mix(docs: DataFrame, epochs: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0,
        block_words: int = 64, shards: int | None = None, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``size`` counts words (null text: 0); ``taken`` is how many words the mix takes of the document,
    repeats counted, at most ``most`` times its size. A source's taken words differ from its target
    by about a block; the result depends on ids, sizes and the seed alone. A null source is a source
    of its own, the last one; rows that repeat a doc_id are documents of their own. Sources without
    words have target 0. Other columns are ignored; an empty table gives an empty table.
    A shard's rows are sorted together. If ``shards`` is not given, the rows are counted and there is
    one for each SHARD_ROWS of them, SHARDS at least, so that shards stay small however many rows one
    source has.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = staged(sized.withColumn("shard", seeded(seed + "-shard", F.col("doc_id"))), "sizes")
    shards = shards or max(SHARDS, -(-sized.count() // SHARD_ROWS))
    sized = sized.withColumn("shard", F.pmod("shard", F.lit(shards)))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]

    per_shard = sized.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((2 * F.col("words") + block_words) / F.lit(2 * block_words)))).otherwise(F.lit(0)).cast("long")
    per_shard = staged(per_shard.withColumn("blocks", blocks), "shards")
    per_source = per_shard.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("source_blocks"))
    aims = targets(per_source.select("source", "source_size"), epochs, weights, most)
    s = aims.join(per_source.drop("source_size").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    s = s.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    s = s.withColumn("all", F.lit(1)).withColumn("seats", F.round(F.sum("share").over(Window.partitionBy("all"))).cast("long"))
    s = sainte_lague(s, ["all"], "share", "seats", [F.col("source").isNull(), F.col("source")])
    s = s.select("source", "source_size", "target", F.least("seats_won", (F.lit(most) * F.col("source_blocks")).cast("long")).alias("seats"))
    p = per_shard.withColumnRenamed("source", "_s").join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = sainte_lague(p.withColumn("none", F.col("source").isNull()), ["none", "source"], "blocks", "seats", [F.col("shard")])
    quotas = quotas.select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "words", "blocks",
        F.least("seats_won", (F.lit(most) * F.col("blocks")).cast("long")).alias("quota"),
        seeded(seed + "-offset", F.col("source"), F.col("shard")).alias("offset"),
    )
    d = sized.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    lay = Window.partitionBy("source", "shard").orderBy(seeded(seed + "-order", F.col("doc_id")), "doc_id", "size")
    d = d.withColumn("end", F.sum("size").over(lay.rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.expr(f"""
        CASE WHEN size = 0 THEN 0L ELSE aggregate(
            sequence(((end - size + 1) * blocks - 1) div words, (end * blocks - 1) div words), 0L,
            (sum, j) -> sum + (least(end, ((j + 1) * words) div blocks) - greatest(end - size, (j * words) div blocks))
                            * (quota div blocks + CASE WHEN (j * {STRIDE}L + offset) % blocks < quota % blocks THEN 1L ELSE 0L END))
        END""")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix has them: each row 0, 1 or 2 times, all columns kept.

    A row of which ``taken / size`` = 1.4 stands once, and a second time with probability 0.4, drawn
    from its doc_id, so that sources keep their targets. Rows without words stay as they are."""
    seed = options.get("seed", "mix")
    m = mix(docs, **options).withColumn("u", seeded(seed + "-copies", F.col("doc_id")) / F.lit(float(2**32)))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.col("u"))).otherwise(F.lit(1))
    m = m.select(F.col("doc_id").alias("_mix_id"), copies.cast("int").alias("_mix_copies")).groupBy("_mix_id").agg(F.max("_mix_copies").alias("_mix_copies"))
    kept = docs.join(m.filter("_mix_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    return kept.withColumn("_mix_copies", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-shard|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT greatest(128, (count(*) + 65535) // 65536) FROM documents) AS shard
  FROM documents),
per_shard AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(1, (2 * words + 64) // 128) ELSE 0 END::BIGINT AS blocks
  FROM (SELECT source, shard, sum(size)::BIGINT AS words FROM sized GROUP BY ALL)),
per_source AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2.0::DOUBLE * source_size AS most
  FROM (SELECT source, sum(words)::BIGINT AS source_size, sum(blocks)::BIGINT AS source_blocks FROM per_shard GROUP BY ALL)),
filling AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level,
         most / weight AS ratio
  FROM per_source WINDOW f AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, source_blocks,
         coalesce(least(most, (SELECT level FROM filling WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1) * weight), most)::DOUBLE AS target
  FROM filling),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * source_blocks / source_size ELSE 0 END AS share FROM aims),
seats AS (SELECT *, round(sum(share) OVER ())::BIGINT AS n_seats FROM shares),
source_quotients AS (
  SELECT s.source, s.share / (2 * k.k + 1) AS q, k.k, s.n_seats
  FROM seats s, LATERAL (SELECT unnest(range(0, (s.share * 2 + 4)::BIGINT)) AS k) k WHERE s.share > 0),
source_won AS (
  SELECT source, count(*) AS won FROM (
    SELECT source, n_seats, row_number() OVER (ORDER BY q DESC, source IS NULL, source, k) AS r FROM source_quotients)
  WHERE r <= n_seats GROUP BY ALL),
source_seats AS (
  SELECT s.source, s.source_size, s.target, least(coalesce(w.won, 0), 2 * s.source_blocks) AS n_seats
  FROM seats s LEFT JOIN source_won w ON s.source IS NOT DISTINCT FROM w.source),
shard_quotients AS (
  SELECT p.source, p.shard, p.blocks / (2 * k.k + 1) AS q, k.k, s.n_seats
  FROM per_shard p JOIN source_seats s ON p.source IS NOT DISTINCT FROM s.source,
       LATERAL (SELECT unnest(range(0, 2 * p.blocks + 3)) AS k) k WHERE p.blocks > 0),
shard_won AS (
  SELECT source, shard, count(*) AS won FROM (
    SELECT source, shard, n_seats, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS r FROM shard_quotients)
  WHERE r <= n_seats GROUP BY ALL),
quotas AS (
  SELECT p.*, s.source_size, s.target, least(coalesce(w.won, 0), 2 * p.blocks) AS quota,
         ('0x' || substr(md5('mix-offset|' || coalesce(p.source, '') || '|' || p.shard), 1, 8))::BIGINT AS off
  FROM per_shard p JOIN source_seats s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN shard_won w ON p.source IS NOT DISTINCT FROM w.source AND p.shard = w.shard),
laid AS (
  SELECT d.doc_id, d.size, q.*, sum(d.size) OVER (PARTITION BY d.source, d.shard
           ORDER BY ('0x' || substr(md5('mix-order|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT, d.doc_id, d.size
           ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
         list_sum(list_transform(range(((fin - size + 1) * blocks - 1) // words, (fin * blocks - 1) // words + 1),
           lambda j: (least(fin, ((j + 1) * words) // blocks) - greatest(fin - size, (j * words) // blocks))
             * (quota // blocks + CASE WHEN (j * 2147483647 + off) % blocks < quota % blocks THEN 1 ELSE 0 END))) END::BIGINT AS taken
FROM laid
"""
