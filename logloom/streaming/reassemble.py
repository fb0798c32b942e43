"""Re-assembly of lines from a stream of chunks, with the open line kept between batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..limits import DEFAULT_CHUNK, check_range
from ..operators.framing import BLOCK_SPAN, assemble, chunk_rows

# Table layout: one folder per micro-batch, and in it complete pieces apart from
# the open line of every stream.
_BATCH, _OPEN = "batch_id", "is_open"


def _schema(streams: list[T.StructField], binary: bool) -> T.StructType:
    return T.StructType(
        [
            *streams,
            T.StructField("line_no", T.LongType()),
            T.StructField("piece_no", T.LongType()),
            T.StructField("line", T.BinaryType() if binary else T.StringType()),
            T.StructField(_OPEN, T.IntegerType()),
        ]
    )


def reassemble_stream(
    chunk_stream: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    stream: str | Sequence[str] = "stream_id",
    seq: str = "seq",
    data: str = "data",
    max_len: int = DEFAULT_CHUNK,
    span: int = BLOCK_SPAN,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that turns a stream of chunks into a table of lines under `out_dir`.

    Every micro-batch is re-assembled by the same distributed job as a table of
    chunks, so one stream may hold most of the input. Between batches each
    stream keeps its open piece, of less than `max_len` characters, and its
    position; both are rows of the table in the shared folder, read back by the
    next batch. A batch that runs again after a failure overwrites its own
    folder, so every line appears once.

    Binary chunks are cut by bytes, and their pieces are binary. A row with NULL
    `data` ends its stream at its own `seq`: the unfinished line is written, and
    chunks of a larger `seq` are a new stream of the same id, with lines from 0.
    Batches must arrive in the order of `seq`, and `out_dir` must be new or belong
    to this checkpoint. Read the result with `read_reassembled`.
    """
    check_range("max_len", max_len, 1)
    streams = [stream] if isinstance(stream, str) else list(stream)
    binary = isinstance(chunk_stream.schema[data].dataType, T.BinaryType)
    schema = _schema([chunk_stream.schema[name] for name in streams], binary)
    line = F.col("line")

    def open_lines(spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        kept = spark.read.schema(schema).parquet(f"{out_dir}/{_BATCH}={batch_id - 1}")
        return kept.filter(F.col(_OPEN) == 1)

    def process(batch: DataFrame, batch_id: int) -> None:
        chunks, _, _ = chunk_rows(batch, streams, seq, data)
        # The open line of a stream comes back as a chunk in front of the others.
        carried = open_lines(batch.sparkSession, batch_id).select(
            F.struct(*streams).alias("ids"),
            F.lit(-1).cast("bigint").alias("seq"),
            (F.decode(line, "ISO-8859-1") if binary else line).alias("text"),
            F.col("line_no").alias("skip_lines"),
            (F.col("piece_no") * max_len).alias("skip_chars"),
        )
        # The ends that a stream has in this batch, in order: they cut it into parts. An end
        # without a number would be lost, and two streams be one.
        missing = F.raise_error(F.lit("seq must not be NULL")).cast("bigint")
        at = F.coalesce(F.col(seq).cast("bigint"), missing)
        ends = (
            batch.filter(F.col(data).isNull())
            .groupBy(F.struct(*streams).alias("ids"))
            .agg(F.sort_array(F.collect_set(at)).alias("ends"))
        )
        pieces = assemble(chunks.unionByName(carried), max_len, span, ends)
        # Only what follows the last end goes on in the next batch.
        rest = F.col("open") & (F.col("ids.part") < F.col("ids.parts"))
        (
            pieces.filter(~rest | (line != ""))
            .withColumn(_OPEN, (F.col("open") & ~rest).cast("int"))
            .withColumn("line", F.encode(line, "ISO-8859-1") if binary else line)
            .select(
                *[F.col("ids.ids")[name].alias(name) for name in streams],
                "line_no", "piece_no", "line", _OPEN,
            )
            .write.mode("overwrite")
            .partitionBy(_OPEN)
            .parquet(f"{out_dir}/{_BATCH}={batch_id}")
        )

    return (
        chunk_stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_reassembled(
    spark: SparkSession,
    out_dir: str,
    streams: list[T.StructField],
    with_open: bool = False,
    binary: bool = False,
) -> DataFrame:
    """The lines written so far; `with_open` adds the unfinished last line of every stream.

    `streams` are the id columns of the chunk stream; `binary` says that its
    chunks were binary.
    """
    schema = _schema(streams, binary)
    table = spark.read.schema(schema.add(_BATCH, T.LongType())).parquet(out_dir)
    done = table.filter(F.col(_OPEN) == 0)
    if with_open:
        latest = table.agg(F.max(_BATCH).alias("latest"))
        last = table.join(F.broadcast(latest), F.col(_BATCH) == F.col("latest")).filter(
            (F.col(_OPEN) == 1) & (F.octet_length("line") > 0)
        )
        done = done.unionByName(last.drop("latest"))
    return done.drop(_OPEN, _BATCH)
