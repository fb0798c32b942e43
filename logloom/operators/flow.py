"""Load shedding on tables: keep the first rows of every bucket and account for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import check_free, check_range, names
from ..session import settled


def first_rows(
    df: DataFrame,
    bucket: str | Sequence[str],
    order: str | Sequence[str],
    capacity: int,
    used: DataFrame | None = None,
) -> DataFrame:
    """The first rows of every bucket, exactly as many as `capacity` less what `used` says.

    `used` has the bucket columns and `used`, one row per bucket. Only buckets and
    orders are sorted, by range, so a bucket that is most of the table is spread
    over many tasks, and so are rows of equal order. Counts per bucket and range, added up
    over the few ranges of each bucket, tell in which range the last row of a bucket
    stands, and its place there. The rows themselves are compared with that row
    and not shuffled, unless there are too many buckets to send around. Where
    more rows have the order of the last one than there is room for, these rows, and only
    these, are dealt their quota in the order of a hash of the whole row (`_quota`).
    """
    buckets, orders = names(bucket), names(order)
    check_free(
        df.columns, ("_bucket", "_order", "_last", "_none", "_room", "_tied", "_hash", "_row", "_part")
    )
    # A number per row splits equal orders over ranges.
    narrow = df.select(
        F.struct(*buckets).alias("b"), F.struct(*orders).alias("o"),
        F.monotonically_increasing_id().alias("t"),
    )
    ranged = settled(
        narrow.repartitionByRange("b", "o", "t")
        .sortWithinPartitions("b", "o", "t")
        .select(
            "b", "o", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shed-order",
    )
    counts = _places(ranged, "b", "part", "place").withColumn(
        "all", F.sum("n").over(Window.partitionBy("b"))
    )
    room = F.lit(capacity).cast("bigint")
    if used is not None:
        taken = used.select(F.struct(*buckets).alias("b"), "used")
        counts = counts.join(taken, "b", "left")
        room = room - F.coalesce("used", F.lit(0))
    over = counts.withColumn("room", F.greatest(room, F.lit(0))).filter(F.col("all") > F.col("room"))
    # The range with the last row that is kept; its first one where none is.
    at = (F.col("ahead") < F.greatest("room", F.lit(1))) & (
        F.col("ahead") + F.col("n") >= F.greatest("room", F.lit(1))
    )
    last = over.filter(at).select(
        "b", "part", "room",
        (F.col("first") + F.greatest("room", F.lit(1)) - F.col("ahead") - 1).alias("place"),
    )
    cut = settled(
        last.join(ranged, ["b", "part", "place"]).select("b", F.col("o").alias("last"), "room"),
        "shed-cuts",
    )
    # Of the rows with the order of the last one: how many there are, and how many have room.
    seen = Observation()
    place = F.col("ahead") + F.col("place") - F.col("first") + 1
    limits = settled(
        ranged.join(cut.filter("room > 0"), "b")
        .filter(F.col("o") == F.col("last"))
        .join(counts.select("b", "part", "ahead", "first"), ["b", "part"])
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("tied"), F.count_if(place <= F.col("room")).alias("fit"))
        .join(cut, "b", "right")
        .select(
            F.col("b").alias("_bucket"),
            F.col("last").alias("_last"),
            (F.col("room") == 0).alias("_none"),
            F.when(F.col("tied") > F.col("fit"), F.col("fit")).alias("_room"),
        )
        .observe(seen, F.count("_room").alias("short")),
        "shed-limits",
    )
    own = F.struct(*orders)
    inside = F.when(F.col("_room").isNull(), own <= F.col("_last")).otherwise(own < F.col("_last"))
    kept = df.join(limits, F.struct(*buckets) == F.col("_bucket"), "left").filter(
        F.coalesce(~F.col("_none") & inside, F.col("_bucket").isNull())
    )
    if seen.get["short"]:
        kept = kept.unionByName(_quota(df, limits.filter("_room IS NOT NULL"), buckets, orders))
    return kept.drop("_bucket", "_last", "_none", "_room")


def _places(ranged: DataFrame, bucket: str, part: str, place: str) -> DataFrame:
    """Per bucket and range: rows `n`, the `first` place, and the rows `ahead` of the range."""
    before = Window.partitionBy(bucket).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.groupBy(bucket, part)
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )


def _quota(df: DataFrame, limits: DataFrame, buckets: list[str], orders: list[str]) -> DataFrame:
    """Of the rows with the order of the last one, `_room` per bucket, whichever task has them.

    They are sorted by range, by a hash of their columns, so that a second run keeps the same;
    rows that are equal in all columns may be kept one for the other. Counts per bucket
    and range say which rows of a range are within the quota.
    """

    def hashed(field: T.StructField) -> Column:
        # Maps have no hash.
        simple = "map<" not in field.dataType.simpleString()
        return F.col(field.name) if simple else F.to_json(F.struct(field.name))

    tied = (
        df.join(limits, F.struct(*buckets) == F.col("_bucket"))
        .filter(F.struct(*orders) == F.col("_last"))
        .withColumn("_hash", F.xxhash64(*[hashed(f) for f in df.schema]))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    key = ["_bucket", "_hash", "_row"]
    ranged = settled(
        settled(tied, "shed-tied")
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "shed-quota",
    )
    places = _places(ranged, "_bucket", "_part", "_row").drop("n")
    return (
        ranged.join(places, ["_bucket", "_part"])
        .filter(F.col("ahead") + F.col("_row") - F.col("first") < F.col("_room"))
        .drop("_hash", "_row", "_part", "first", "ahead")
        .select(*df.columns, "_bucket", "_last", "_none", "_room")
    )


def shed(
    df: DataFrame, bucket: str | Sequence[str], order: str | Sequence[str], capacity: int
) -> DataFrame:
    """The first `capacity` rows of every bucket in the order of `order`.

    NULL buckets are a bucket. Of rows with equal order as many are kept as there is room
    for, always the same ones. The same plan serves every capacity, and no task
    ever ranks a whole bucket; it first runs jobs over the bucket and order columns
    (see `first_rows`).
    """
    check_range("capacity", capacity, 1)
    return first_rows(df, bucket, order, capacity)


def shed_counts(capacity: int) -> list:
    """Aggregates of a shedding report: `arrived`, `kept`, `dropped`."""
    check_range("capacity", capacity, 1)
    arrived = F.count(F.lit(1))
    return [
        arrived.alias("arrived"),
        F.least(arrived, F.lit(capacity).cast("bigint")).alias("kept"),
        F.greatest(arrived - capacity, F.lit(0).cast("bigint")).alias("dropped"),
    ]


def shed_report(df: DataFrame, bucket: str | Sequence[str], capacity: int) -> DataFrame:
    """Per bucket how many rows arrived, are kept, and are dropped. Needs no ranking."""
    return df.groupBy(*names(bucket)).agg(*shed_counts(capacity))
