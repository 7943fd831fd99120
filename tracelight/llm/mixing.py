"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.llm.common import WORD, cut, stored, table, unused, with_ids

#: Weights that the sources take in turn, in order of their names.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MAX_REPEAT = 3


def words(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) that is fixed by the row's columns and the seed: 52 bits of an MD5 digest."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``source``, ``source_size``, ``target`` of the sources in ``sizes(source, size)``.

    Sources in code-point order (null last) take the weights in turn and share
    the sum of all sizes in proportion. A target stops at ``max_repeat`` times
    its source's size; what it gives up is shared again by weight. Resharing
    until none is above ends with ``min(cap, weight * level)`` for one common
    level: with sources in order of cap / weight, those before some place are
    capped, and the level is what is left over the weights that are left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    place = F.row_number().over(by_room)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_repeat))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # the first place whose source is not above its cap sets the level
        .withColumn("place", place)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("place", "level"))).over(whole)["level"])
    )
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 17
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    A source's rate is target / source_size; a document is emitted
    floor(rate) times, and once more if a number drawn from its id, its text's digest and the
    seed is below the rate's fraction, so reruns agree and no document passes
    ``max_repeat`` copies. Null and empty texts have size 0 and take nothing; a
    source without words has target 0; null is a source of its own; rows that
    repeat with the same id and text are drawn alike, rows that share an id or have none by their texts; no rows give no rows; extra columns are ignored.
    """
    draw = uniform(seed, "doc_id", F.md5(F.col("text").cast("binary")))
    # narrow rows, kept, so that whole texts are read and counted once
    sizes = stored(with_ids(docs, "doc_id", "source", "text").select("doc_id", "source", words().alias("size"), draw.alias("draw")))
    rates = source_targets(sizes, weights, max_repeat).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sizes.join(rates, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def emit(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """The mix itself: a row per copy, with all columns of ``docs``, then ``mix_copy`` (from 1), ``mix_size`` and ``mix_target``.

    Columns of ``docs`` with these names are replaced.
    Copies are those of ``mix``. The sources' rates are broadcast if there are
    at most ``max_sources`` of them, so that texts stay where they are; beyond
    that they are joined by source, and adaptive execution splits a hot one.
    """
    rates = cut(source_targets(docs.select("source", words().alias("size")), weights, max_repeat))
    own = unused(docs, "mix_rate", "mix_place", "mix_zero")
    rates = rates.select(F.struct("source", "source_size", "target").alias(own[0]))
    side = F.broadcast(rates) if rates.count() <= max_sources else rates
    joined = docs.join(side, docs.source.eqNullSafe(rates[own[0]]["source"]))
    size, target = rates[own[0]]["source_size"], rates[own[0]]["target"]
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(uniform(seed, "doc_id", F.md5(docs.text.cast("binary"))) < rate - F.floor(rate), 1).otherwise(0)
    new = {"mix_size": words(), "mix_target": target}
    out = joined.select("*", F.posexplode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(*own[1:]))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*new, "mix_copy")]
    return out.select(*kept, (F.col(own[1]) + 1).alias("mix_copy"), *[c.alias(n) for n, c in new.items()])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


OP6_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(md5(text), '') AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM t),
l AS (SELECT a.cap / a.weight AS room,
        (SELECT sum(least(b.cap, b.weight * (a.cap / a.weight))) FROM w b) AS filled,
        (SELECT coalesce(sum(b.cap), 0) FROM w b WHERE b.cap / b.weight < a.cap / a.weight) AS capped,
        (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS open_weight
      FROM w a),
lev AS (SELECT ((SELECT sum(source_size) FROM t) - capped) / open_weight AS level FROM l
        WHERE filled >= (SELECT sum(source_size) FROM t) ORDER BY room LIMIT 1),
g AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM lev)) AS target FROM w),
r AS (SELECT s.doc_id, s.size, g.source_size, g.target,
        CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
        ('0x' || md5('17:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.digest)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
