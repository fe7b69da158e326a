"""Mixing sources to target weights by capped water-filling.

A source's target is its weight times a common water level, at most ``max_epochs`` times its own size; the level is
where all targets add up to the asked total, which is what clamping and resharing by weight comes to in the end. A
source is then taken in whole repetitions, and a last, fractional one takes its documents in the order of a seeded
hash up to the word that is nearest to the target.

Finding that place needs no sort of a source: sums by the first digits of the hash name the slice that holds it, sums
by further digits a thinner slice within, and only the documents of the last slice are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import words_of

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash digits of the two slicings: 4,096 slices, then 4,096 of one of those.
DIGITS = (3, 6)
#: One row for each source is broadcast up to so many sources.
MOST_SOURCES = 100_000


def ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with rank, the place of each source by code points from 0, null last. Ranges of sources are ranked apart
    and shifted by the sizes of those before, so only one number for each range meets in a single task."""
    ranges = common.stored(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    shifts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    shifts = shifts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("within", within).join(shifts, "part").withColumn("rank", F.col("shift") + F.col("within") - 1).drop("part", "shift", "within")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``, one row for each source.

    The water level starts at the asked total over all weights. Sources that it would take beyond their cap are clamped,
    and what they leave is shared anew among the others by weight, until none is above; each round is one aggregate."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = common.stored(ranked(totals).select("source", "source_size", weight.alias("weight"), (max_epochs * F.col("source_size")).alias("cap")), "mix-weights")
    asked, level, clamped = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share), 0.0, -1
    while True:
        above = F.lit(False) if clamped < 0 else F.col("cap") / F.col("weight") < level
        got = rows.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if got["n"] == clamped or not got["free"]:
            level = level if got["free"] else float("inf")
            break
        clamped, level = got["n"], (asked - got["caps"]) / got["free"]
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, whole, cut, cut_size): whole repetitions, and the last document of the fractional one.

    ``sizes(source, size, key)``; rows of the same source, key and size stand or fall together."""
    goal = targets(sizes, weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = common.stored(goal.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    few = goal.count() <= MOST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    edge = goal.where("part > 0").select(F.col("source").alias("s"), "part", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for digits in DIGITS:
        inside = sizes.join(small(edge), sizes.source.eqNullSafe(F.col("s")) & sizes.key.startswith(F.col("prefix")))
        slices = inside.groupBy("s", "part", "base", F.substring("key", 1, digits).alias("slice")).agg(F.sum("size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        found = slices.withColumn("upto", upto).where("upto >= part").groupBy("s", "part").agg(F.min(F.struct("slice", "upto", "words")).alias("x"))
        edge = common.stored(found.select("s", "part", F.col("x.slice").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("base")), "mix-edge")
    last = sizes.join(small(edge), sizes.source.eqNullSafe(F.col("s")) & sizes.key.startswith(F.col("prefix")))
    last = last.groupBy("s", "part", "base", "prefix", "key", "size").agg(F.sum("size").alias("words"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).withColumn("in", 2 * F.col("upto") - F.col("words") <= 2 * F.col("part"))
    cuts = last.groupBy("s", "prefix").agg(F.max(F.when(F.col("in"), F.struct("key", "size"))).alias("x"))
    cuts = cuts.select("s", F.coalesce("x.key", "prefix").alias("cut"), F.coalesce("x.size", F.lit(-1)).alias("cut_size"))
    return goal.join(cuts, goal.source.eqNullSafe(cuts.s), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("cut_size", F.lit(-1)).alias("cut_size"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    seed: str = SEED,
    carry_text: bool = True,
) -> DataFrame:
    """Each row of ``docs`` as (row, size, source_size, target, copies); row is a struct of all its columns, or of all but
    the text without ``carry_text``; then texts are read once and never stored.

    Sources in order of code points, null last, take ``weights`` in turn. Sizes count words; a null text has none.
    Rows of one source that share id and size stand or fall together, so repeated rows and reruns agree. A source
    without words has the target 0. Taken words come within half a document (or half a group of such repeated rows) of
    the target. An empty table gives an empty result."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")
    row = F.struct(*([docs[c] for c in docs.columns if carry_text or c != text_col] or [F.lit(0).alias("none")])).alias("row")
    sized = (F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), key)
    sizes = common.stored(docs.select(*([] if carry_text else [row]), *sized), "mix-sizes")
    chosen = common.stored(plan(sizes.select("source", "size", "key"), weights, max_epochs, share), "mix-plan").withColumnRenamed("source", "s")
    if chosen.count() <= MOST_SOURCES:
        chosen = F.broadcast(chosen)
    rows = (docs.select(row, *sized) if carry_text else sizes).join(chosen, F.col("source").eqNullSafe(F.col("s")))
    more = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("size") <= F.col("cut_size")))
    return rows.select("row", "size", "source_size", "target", (F.col("whole") + more.cast("int")).alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what the mix takes of every document."""
    found = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry_text=False)
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS full_at FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM c),
t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * weight) AS target FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, key, size, sum(size)::BIGINT AS words FROM d GROUP BY source, key, size),
o AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto FROM g),
m AS (
  SELECT o.source, key, size, source_size, target, whole, (2 * upto - words)::DOUBLE <= 2 * (target - whole * source_size) AS more
  FROM o JOIN w ON o.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, d.size, source_size, target, (whole + CASE WHEN more THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.key = m.key AND d.size = m.size
"""
