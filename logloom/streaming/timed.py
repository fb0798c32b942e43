"""Re-assembly of lines with keyed state: an open line is written once its stream is idle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..limits import DEFAULT_CHUNK, check_free, check_range, names

#: What ended a piece: a line feed, the size limit, an end marker, or the timeout. A late
#: chunk is no piece; it is handed out as it came.
FEED, SIZE, END, TIMEOUT, LATE = "feed", "size", "end", "timeout", "late"

# Keyed state with timers needs this store. With change logs a batch writes what changed,
# not a copy of the state of every partition.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_STATE = "text string, line_no bigint, piece_no bigint, started bigint, seq bigint, timer bigint"
_PIECE = ["started_micros", "line_no", "piece_no", "line", "seq", "ended_by"]
_OWN = ("chunk_micros", "chunk_seq", "chunk_text", "started", *_PIECE)


class _Open:
    """The open line of one stream, and the pieces that it has given so far."""

    def __init__(self, max_len: int, text: str, line_no: int, piece_no: int, started: int):
        self.max_len, self.text, self.started = max_len, text, started
        self.line_no, self.piece_no = line_no, piece_no
        self.pieces: list[tuple] = []

    def _give(self, line: str, seq: int, reason: str) -> None:
        self.pieces.append((self.started, self.line_no, self.piece_no, line, seq, reason))

    def add(self, part: str, seq: int) -> None:
        """More of the line; every full piece is given at once."""
        text, size = self.text + part, self.max_len
        full = len(text) // size
        for k in range(full):
            self._give(text[k * size : (k + 1) * size], seq, SIZE)
            self.piece_no += 1
        self.text = text[full * size :]

    def close(self, seq: int, reason: str) -> None:
        """The line ends. A rest that is empty is a piece only if a line feed ends it alone."""
        if self.text or (reason == FEED and self.piece_no == 0):
            self._give(self.text, seq, reason)
        self.text, self.piece_no = "", 0
        self.line_no += 1


class _Lines(StatefulProcessor):
    """Per stream, its open line and the timer that ends it."""

    def __init__(self, max_len: int, idle_ms: int, streams: list[str]):
        self.max_len, self.idle_ms = max_len, idle_ms
        self.row = Row(*streams, *_PIECE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # The chunks that one batch has of one stream, which the intake of a batch bounds.
        chunks = sorted(rows, key=lambda row: row["chunk_seq"])
        mark = timerValues.getCurrentWatermarkInMs()
        held = self.state.get()
        timer, last_seq, pieces = None, None, []
        line = None
        if held is not None:
            text, line_no, piece_no, started, last_seq, timer = held
            line = _Open(self.max_len, text, line_no, piece_no, started)
        before = timer
        for chunk in chunks:
            seq, micros, text = chunk["chunk_seq"], chunk["chunk_micros"], chunk["chunk_text"]
            closes = micros // 1000 + self.idle_ms
            if line is None and closes <= mark:
                # Its line, if there was one, has been ended without it.
                if text is not None:
                    pieces.append((micros, None, None, text, seq, LATE))
                continue
            if line is not None and seq <= last_seq:
                raise ValueError(f"seq {seq} of a stream comes after {last_seq}")
            if text is None:
                if line is not None:
                    line.close(seq, END)
                    pieces += line.pieces
                line, timer = None, None
                continue
            if line is None:
                line = _Open(self.max_len, "", 0, 0, micros)
            *ended, rest = text.split("\n")
            for part in ended:
                line.add(part, seq)
                line.close(seq, FEED)
            line.add(rest, seq)
            last_seq, timer = seq, max(timer or 0, closes)
        if line is not None:
            pieces += line.pieces
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                # What is due already is due after this batch.
                self.handle.registerTimer(timer)
        if line is None:
            if held is not None:
                self.state.clear()
        else:
            self.state.update(
                (line.text, line.line_no, line.piece_no, line.started, last_seq, timer)
            )
        for piece in pieces:
            yield self.row(*key, *piece)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is None or expiredTimerInfo.getExpiryTimeInMs() != held[-1]:
            return
        text, line_no, piece_no, started, seq, _ = held
        line = _Open(self.max_len, text, line_no, piece_no, started)
        line.close(seq, TIMEOUT)
        self.state.clear()
        for piece in line.pieces:
            yield self.row(*key, *piece)

    def close(self) -> None:
        pass


# Sent to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_Lines"]))


def _millis(spark: SparkSession, interval: str) -> int:
    micros = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))
    return spark.range(1).select(micros).first()[0] // 1000


def reassemble_timed(
    chunk_stream: DataFrame,
    event_time: str,
    idle: str = "10 minutes",
    delay: str = "0 seconds",
    stream: str | Sequence[str] = "stream_id",
    seq: str = "seq",
    data: str = "data",
    max_len: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Lines of a stream of chunks, as a stream: no line stays open for longer than `idle`.

    Returns the stream columns, `started` (time of the first chunk), `line_no` from 0,
    `piece_no`, `line`, `seq` (of the chunk that gave the piece) and `ended_by`: `feed`
    for a line feed, `size` for a piece of `max_len` characters, `end` for an end marker
    (a chunk with NULL `data`), `timeout`, or `late`. Write it with any sink in append mode.

    The open line of each stream is keyed state, of less than `max_len` characters, and a
    batch touches only the streams that it has chunks of. A stream is idle when the watermark,
    which is the latest event time less `delay`, is `idle` after its last chunk. Then its open
    line is written and its state is gone; chunks that follow are a new stream of
    the same id, with its own `started` and lines from 0. A chunk that is itself
    older than that and finds no open stream comes too late: it is handed out as a row
    `late` with its text and without numbers, so that nothing is lost. State, timers
    and watermark are in the checkpoint, and a query that is started again goes on from them.
    The store that this needs is set for the session.

    Within a batch chunks are put in order; over batches they must arrive in the order
    of `seq`, or the query fails, as it does for a NULL `seq` or event time. NULL stream
    ids are a stream. Binary chunks are cut by bytes, and their pieces are binary.
    The chunks of a stream in one batch go to one task; where one stream is most of the
    input and needs no timeout, `reassemble_stream` spreads it.
    """
    check_range("max_len", max_len, 1)
    streams = names(stream)
    check_free(streams, _OWN)
    spark = chunk_stream.sparkSession
    # Read when the query starts.
    for setting, value in _STORE.items():
        spark.conf.set(setting, value)
    binary = isinstance(chunk_stream.schema[data].dataType, T.BinaryType)
    types = {name: chunk_stream.schema[name].dataType for name in streams}

    def needed(value: Column, name: str) -> Column:
        return F.coalesce(value, F.raise_error(F.lit(f"{name} must not be NULL")).cast("bigint"))

    rows = (
        chunk_stream.withColumn("_mark", F.col(event_time).cast("timestamp"))
        .withWatermark("_mark", delay)
        .select(
            *streams,
            # Not the watermarked column itself: late chunks are to be seen.
            needed(F.unix_micros("_mark"), event_time).alias("chunk_micros"),
            needed(F.col(seq).cast("bigint"), seq).alias("chunk_seq"),
            (F.decode(F.col(data), "ISO-8859-1") if binary else F.col(data)).alias("chunk_text"),
        )
    )
    out = T.StructType(
        [
            *[T.StructField(name, types[name]) for name in streams],
            T.StructField("started_micros", T.LongType()),
            T.StructField("line_no", T.LongType()),
            T.StructField("piece_no", T.LongType()),
            T.StructField("line", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("ended_by", T.StringType()),
        ]
    )
    pieces = rows.groupBy(*streams).transformWithState(
        _Lines(max_len, _millis(spark, idle), streams), out, "Append", "EventTime"
    )
    line = F.encode("line", "ISO-8859-1") if binary else F.col("line")
    return pieces.select(
        *streams,
        F.timestamp_micros("started_micros").alias("started"),
        "line_no", "piece_no", line.alias("line"), "seq", "ended_by",
    )
