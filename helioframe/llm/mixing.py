"""Mixing sources to target weights: whole copies by the floor of the rate, one more by a hash-seeded Bernoulli draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import apart, n_words, stage

#: Weights of the sources in code-point order (null last), repeated.
WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, "mix-1"
#: A table of at most this many sources is broadcast (about 10 MB); a larger one is joined on its key.
BROADCAST_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the sum of all sizes shared by weight, none above limit x size.

    Resharing the excess until no source is above its limit ends at the level L with sum(min(limit * size, weight * L))
    equal to the total. Sources in order of limit * size / weight are limited up to some rank, so running sums find L.
    One row per source reaches these windows, as the sizes are already summed.
    """
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", limit * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    before = Window.orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("at", "i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("at", "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    room = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = capped.withColumn("level", room.cast("double") / F.sum("w").over(rest))
    first = F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "i", "level"))).over(everything)["level"]
    return level.withColumn("l", first).select("source", "source_size", F.when(F.col("l").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("l"))).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the document's id; the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


P = "__mix_"


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The columns of docs with size, source_size, target and copies (how often the mix takes the row), prefixed with P;
    columns of docs that start with P are left out.

    The rate is target / source_size. Null texts have size 0; null sources are one source, last in order. A source of
    size 0 has target 0 and takes nothing. Rows that repeat a doc_id draw alike; null ids draw as the empty string.
    """
    sized = docs.select([c for c in docs.columns if not c.lower().startswith(P)]).withColumn(P + "size", n_words(F.col("text").cast("string")))
    sizes = stage(sized.groupBy("source").agg(F.sum(P + "size").alias("source_size")), "sizes")
    goal = stage(targets(sizes, weights, limit), "targets", [sizes]).select(F.col("source").alias(P + "of"), F.col("source_size").alias(P + "source_size"), F.col("target").alias(P + "target"))
    both = sized.join(F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal, sized.source.eqNullSafe(F.col(P + "of")), "left")
    rate = F.coalesce(F.try_divide(P + "target", F.col(P + "source_size").cast("double")), F.lit(0.0))
    times = F.floor(rate) + F.when(draw(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return both.withColumn(P + "copies", times.cast("long")).drop(P + "of")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as `copies` says. Null texts have size 0, but their rows
    are drawn like others of their source. An empty table gives an empty result."""
    own, back = apart(docs, P)
    taken = copies(own, weights, limit).where(F.col(P + "copies") > 0)
    return back(taken.withColumn(P + "copy", F.explode(F.sequence(F.lit(1), F.col(P + "copies").cast("int")))))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    found = copies(docs.select("doc_id", "text", "source"))
    return found.select("doc_id", *[F.col(P + c).alias(c) for c in ("size", "source_size", "target")], (F.col(P + "size") * F.col(P + "copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM s),
c AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r),
l AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), w * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, i LIMIT 1)), CAST(cap AS DOUBLE)) AS target FROM l),
m AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
  CAST('0x' || left(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
