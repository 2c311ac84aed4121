"""Mixing of sources to target weights, with DataFrame functions only.

Sizes are counts of words.  The sources in order of their names (code points, null last) take
the weights in turn; together they get ``total`` times all words.  A source gets at most
``most`` times its own words; what it can't take is shared among the others by weight.  Each
document is taken ``floor(rate)`` times, and once more if its hash, seen as a number from 0 to
1, is below the fraction of its source's rate.

A null source is a source of its own, null or empty texts have size 0 and are taken 0 times in
words, rows with the same doc_id share their draw, equal caps go in the order of their sources,
very long texts are read whole, and an empty table gives an empty result.  Input columns named as
the new ones are replaced in the plan; emit_mix() gives back all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, renamed

#: Sources beyond which their table is joined by shuffle and not broadcast.
BROADCAST_SOURCES = 10_000
MADE = ("size", "source_size", "target", "copies")


def targets(per: DataFrame, weights=(5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with each source's target.

    Sources are capped in the order of cap per weight; the level is what a unit of weight gets
    once the sources before have their caps; it rises until the first source that stays below its cap
    and falls after it, so that the largest level of such sources is the one that holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cap = F.col("source_size") * float(most)
    order = [F.col("cap") / F.col("weight"), F.col("place")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by_name)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1)
    t = per.withColumn("place", place).withColumn("weight", weight).withColumn("cap", cap)
    t = t.withColumn("level", (F.sum("source_size").over(every) * float(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(every)
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "target")


def draw(doc_id, seed: int = 0):
    """A number from 0 to 1 from the md5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def plan_mix(docs: DataFrame, weights=(5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and copies, how often it is taken."""
    sized = docs.select(*[c for c in docs.columns if c not in MADE], F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    per = checkpoint(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most))
    per = per.withColumnRenamed("source", "_source")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return sized.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies)


def emit_mix(docs: DataFrame, **how) -> DataFrame:
    """Every document as often as the mix takes it, in its own columns, whatever their names."""
    plain, names = renamed(docs)
    used = ("doc_id", "text", "source")
    mixed = plan_mix(plain.withColumnsRenamed({names[c]: c for c in used}), **how).filter("copies > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select(*(c if c in used else names[c] for c in docs.columns)).toDF(*docs.columns)


ORACLE_TARGETS = """
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size * 2.0::DOUBLE AS cap FROM per),
weighed AS (SELECT *, (CASE (place - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM placed),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT source, source_size, least(cap, coalesce(weight * max(CASE WHEN cap / weight >= level THEN level END) OVER (), cap)) AS target FROM levels),
mixed AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source),
copied AS (SELECT *, (floor(rate) + (CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS copies FROM mixed)
"""
ORACLE = "WITH" + ORACLE_TARGETS.format(docs="documents") + "SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken FROM copied"
