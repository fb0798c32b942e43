"""Mixing sources to target weights along a training run, with schedules that change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

# Hex digits of the order that number the parts of a source; running totals are
# taken in the parts side by side.
PART_DIGITS = 3
# Fixed values of the contract: weights of the sources in order, and the most
# that is taken of a source, in times its size.
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3.0
# How much the weight of every other source rises, or else falls, over the run:
# it goes from 1 - TILT to 1 + TILT times its mean, in a straight line.
TILT = 0.5

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """Adds `target` to one row per source (`source`, `source_size`).

    The sources in the order of their code points, null last, weigh WEIGHTS in
    turn and share the sum of all sizes; none gets more than MOST times its size.
    All that stay below that limit get the same amount for each unit of weight.
    This level is found in one pass over the sources in the order in which they
    reach their limits, where a source at its limit leaves the rest to the others.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("place", F.row_number().over(ordered)).withColumn(
        "weight", F.get(weights, ((F.col("place") - 1) % len(WEIGHTS)).cast("int"))
    )
    limit = MOST * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = ranked.withColumns(
        {
            "amount": F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The first source that the level does not lift to its limit fixes the level.
    level = F.col("amount") / F.col("weights")
    turn = F.struct((limit / F.col("weight")).alias("limit"), "place")
    below = F.col("weight") * level <= limit
    levels = left.withColumn(
        "level", F.min_by(level, F.when(below, turn)).over(everything)
    )
    return levels.select(
        "source",
        "source_size",
        "place",
        F.least(F.coalesce(F.col("weight") * F.col("level"), limit), limit).alias("target"),
    )


def position(share: Column, place: Column) -> Column:
    """When in the run (0 to 1) a source has given `share` of its words.

    The weight of the source runs from 1 - a to 1 + a, so its integral up to t is
    (1 - a) t + a t^2, and this is its inverse.
    """
    a = F.when(place % 2 == 0, TILT).otherwise(-TILT)
    return (F.sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / (2 * a)


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """What the mix takes of every document, and when.

    The size of a document is its number of runs of anything but ASCII white
    space. Every source is read in an order fixed by hashes, over and over, until
    its target is reached; the last document may be taken in part. Returns per
    row: the id, the source, `size`, `source_size`, `target`, `taken`, and
    `positions`, the place in the run (0 to 1) of each time the document is read:
    the schedule of the source is integrated, and the integral inverted at the
    words read before.

    Null texts have size 0 and take no part, and so do sources without words.
    Null sources are one source, the last. Rows of the same id and size in one
    source are told apart by nothing, so they share out among them what the order
    gives. An empty table gives an empty result. Other columns are not looked at.

    A source may hold most of the rows: running totals are taken inside the parts
    of every source, by ranges of the hash, and over the totals of the parts.
    """
    sized = saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0))
            .cast("bigint")
            .alias("size"),
        ).withColumn(
            "order", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("size").cast("string")))
        ),
        "mix-sized",
    )
    sized = sized.withColumn("part", F.left("order", F.lit(PART_DIGITS)))
    parts = saved(
        sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts"
    )
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
        .join(goals.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal")))
        .select(
            F.col("source").alias("s"), F.col("part").alias("p"),
            "part_start", "source_size", "target", "place",
        )
    )
    inside = (
        Window.partitionBy("source", "part").orderBy("order", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    )
    words = F.round("target").cast("bigint")
    start = F.col("part_start") + F.col("before")
    # Whole passes over the source, and what is left for one more.
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV greatest(source_size, 1)")).otherwise(0)
    placed = placed.withColumns({"start": start, "whole": whole}).withColumn(
        "last",
        F.greatest(
            F.least(words - F.col("whole") * F.col("source_size") - F.col("start"), F.col("size")),
            F.lit(0).cast("bigint"),
        ),
    )
    reads = F.col("whole") + F.when(F.col("last") > 0, 1).otherwise(0)
    share = lambda i: (i * F.col("source_size") + F.col("start")) / F.greatest(words, F.lit(1))
    positions = F.when(
        (F.col("size") > 0) & (reads > 0),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.greatest(reads - 1, F.lit(0).cast("bigint"))),
            lambda i: position(share(i), F.col("place")),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("last")).alias("taken"),
        positions.alias("positions"),
    )


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per reading of a document, range-sorted by its `position` in the run."""
    mix = saved(mixed_documents(docs, id_col, text_col, source_col), "mix")
    reads = mix.select(
        id_col, source_col, "size", "source_size", "target", "taken",
        F.posexplode("positions").alias("reading", "position"),
    )
    return reads.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)
