"""Load shedding on streams: a bounded number of rows per time bucket, with accounting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..limits import check_free, check_range, names
from ..operators.flow import first_rows

_BATCH = "batch_id"
# Of every open bucket, how many rows were admitted; one row without a bucket has
# the latest event time so far.
_STATE = "bucket timestamp, used bigint, latest timestamp"
_REPORT = "bucket timestamp, arrived bigint, kept bigint, late bigint"


def shed_batch(
    batch: DataFrame,
    batch_id: int,
    out_dir: str,
    event_time: str,
    width: str,
    order: str | Sequence[str],
    capacity: int,
    delay: str,
    write: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Admit the rows of one micro-batch; the work of `shed_stream`."""
    spark = batch.sparkSession
    time = F.col(event_time).cast("timestamp")
    state = _state(spark, out_dir, batch_id)
    latest = state.agg(F.max("latest")).first()[0]
    watermark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    # Rows without a time have no bucket, and are late.
    late = F.coalesce(time < watermark, time.isNull())
    rows = batch.withColumn("bucket", _bucket(time, width)).withColumn("_late", late)
    kept = first_rows(
        rows.filter("NOT _late"), "bucket", order, capacity, state.filter("bucket IS NOT NULL")
    ).drop("_late")
    kept.write.mode("overwrite").parquet(f"{out_dir}/kept/{_BATCH}={batch_id}")
    admitted = spark.read.schema(kept.schema).parquet(f"{out_dir}/kept/{_BATCH}={batch_id}")
    if write is not None:
        write(admitted, batch_id)
    admitted = admitted.groupBy("bucket").agg(F.count(F.lit(1)).alias("kept"))
    arrived = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("arrived"), F.count_if("_late").alias("late"), F.max(time).alias("latest")
    )
    both = arrived.join(
        admitted.withColumnRenamed("bucket", "_b"), F.col("bucket").eqNullSafe(F.col("_b")), "left"
    ).select("bucket", "arrived", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), "late", "latest")
    report = f"{out_dir}/report/{_BATCH}={batch_id}"
    both.write.mode("overwrite").parquet(report)
    counted = spark.read.schema(both.schema).parquet(report)
    newest = counted.agg(F.max("latest")).first()[0]
    newest = max(filter(None, (newest, latest)), default=None)
    closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    used = (
        state.filter("bucket IS NOT NULL")
        .select("bucket", "used")
        .unionByName(counted.filter("bucket IS NOT NULL").select("bucket", F.col("kept").alias("used")))
        .groupBy("bucket")
        .agg(F.sum("used").alias("used"))
        .filter(F.coalesce(F.col("bucket") + F.expr(f"INTERVAL {width}") > closed, F.lit(True)))
        .withColumn("latest", F.lit(None).cast("timestamp"))
    )
    mark = spark.range(1).select(
        F.lit(None).cast("timestamp").alias("bucket"),
        F.lit(None).cast("bigint").alias("used"),
        F.lit(newest).cast("timestamp").alias("latest"),
    )
    used.unionByName(mark).write.mode("overwrite").parquet(f"{out_dir}/state/{_BATCH}={batch_id}")


def _bucket(time: Column, width: str) -> Column:
    """Start of the time window. `window` itself would leave out rows without a time."""
    size = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    micros = F.unix_micros(time)
    return F.timestamp_micros(micros - F.pmod(micros, size))


def _state(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{out_dir}/state/{_BATCH}={batch_id - 1}")


def shed_stream(
    stream: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    event_time: str,
    width: str,
    order: str | Sequence[str],
    capacity: int,
    delay: str = "10 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that keeps the first `capacity` rows of every `width` of event time.

    Rows older than the latest event time of all earlier batches less `delay` are
    late and go first, so they take no place from others. Of the others, each
    micro-batch admits the first ones of every bucket in the order of `order`,
    exactly as many as earlier batches left room for, also among equal orders. The rest is
    dropped. Every batch is cut by the same distributed job as a table
    (`first_rows`), so a bucket may be most of the batch.

    `out_dir` must be new or belong to this checkpoint. Per batch it gets the kept
    rows with their `bucket`, the counts, and the places used in buckets that are
    still open; a batch that runs again overwrites its own. Read the rows with
    `read_shed` and the counts with `shed_stream_report`.
    """
    check_range("capacity", capacity, 1)
    check_free(stream.columns, ("bucket", "_late"))
    orders = names(order)

    def process(batch: DataFrame, batch_id: int) -> None:
        shed_batch(batch, batch_id, out_dir, event_time, width, orders, capacity, delay)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_shed(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """The rows kept so far, with their `bucket`; `schema` is that of the stream."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.TimestampType())])
    return spark.read.schema(full).parquet(f"{out_dir}/kept/{_BATCH}=*")


def shed_stream_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per bucket `arrived`, `kept`, `dropped`, and how many of the dropped were `late`.

    The sums of what every batch has written, so it agrees with the kept rows:
    arrived rows are kept or dropped. Rows without an event time are in the NULL
    bucket.
    """
    counts = spark.read.schema(_REPORT).parquet(f"{out_dir}/report/{_BATCH}=*")
    total = counts.groupBy("bucket").agg(
        *[F.sum(name).alias(name) for name in ("arrived", "kept", "late")]
    )
    dropped = (F.col("arrived") - F.col("kept")).alias("dropped")
    return total.select("bucket", "arrived", "kept", dropped, "late")
