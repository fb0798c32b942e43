"""The whole capture: lines in, NDJSON out, as a table job and as a streaming job."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Sequence
from weakref import WeakSet

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..limits import (
    DEFAULT_BUFFER,
    DEFAULT_CHUNK,
    MAX_BUFFER,
    MAX_CHUNK,
    MESSAGE_KEY,
    MIN_BUFFER,
    MIN_CHUNK,
    POLICIES,
    check_choice,
    check_key,
    check_range,
    check_unit,
)
from ..operators.encode import encode_ndjson
from ..operators.fields import FieldSet, fold_fields, join_field_sets, render_prefix
from ..operators.framing import cap_lines, split_lines
from ..sources.text import stream_lines
from ..session import settled
from ..streaming.shed import shed_batch


def capture_frame(
    df: DataFrame,
    id_cols: str | Sequence[str],
    text_col: str,
    fields: FieldSet | Iterable[str] = (),
    max_len: int = DEFAULT_CHUNK,
    unit: str = "char",
    msg_key: str = MESSAGE_KEY,
) -> DataFrame:
    """Texts of a table to records: the id columns, `line_no`, `piece_no`, `json`. No shuffle."""
    pieces = cap_lines(split_lines(df, id_cols, text_col), max_len, unit)
    return encode_ndjson(pieces, "line", FieldSet.of(fields, msg_key), msg_key).drop("line")


def _counted(df: DataFrame, name: str, column: str) -> DataFrame:
    """Count rows and bytes on the way, as the observed metric `name` of the query."""
    return df.observe(name, *_sums(column))


def _sums(column: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(column).cast("bigint")), F.lit(0)).alias("bytes"),
    ]


# Totals of the latest runs that this process has started, by run id.
_TOTALS: OrderedDict[str, dict[str, dict[str, int]]] = OrderedDict()
MAX_RUNS = 1000

_LEDGER = "name string, rows bigint, bytes bigint"
_SOURCE_SETS = "source string, pos bigint, kv string"
_FRONTS = "source string, front string, error string"


def _of_run(run_id: str) -> dict[str, dict[str, int]]:
    totals = _TOTALS.setdefault(run_id, {})
    while len(_TOTALS) > MAX_RUNS:
        _TOTALS.popitem(last=False)
    return totals


def _add(totals: dict[str, dict[str, int]], name: str, row: dict) -> None:
    total = totals.setdefault(name, {"rows": 0, "bytes": 0})
    total["rows"] += row["rows"]
    total["bytes"] += row["bytes"]


class _Totals(StreamingQueryListener):
    """Adds up the observed counts of every batch, however many there are."""

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            if name in ("lines", "pieces", "records"):
                _add(_of_run(str(event.progress.runId)), name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


# Sessions that have a listener; a session that is gone leaves no trace here.
_LISTENING: WeakSet[SparkSession] = WeakSet()


def _listen(spark: SparkSession) -> None:
    if spark not in _LISTENING:
        spark.streams.addListener(_Totals())
        _LISTENING.add(spark)


def captured_totals(query: StreamingQuery) -> dict[str, dict[str, int]]:
    """Rows and bytes of `lines`, `pieces` and `records` over all batches of this run.

    Nothing was lost or invented when lines and pieces have the same bytes, and
    pieces and records the same rows. With `policy="drop"`, `arrived` and `dropped`
    count the lines before the cut: arrived lines are dropped or in `lines`.
    """
    spark = SparkSession.active()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return {name: dict(row) for name, row in _TOTALS.get(str(query.runId), {}).items()}


def _sets_of_batch(
    spark: SparkSession, out_dir: str, batch_id: int, source_sets: str, msg_key: str
) -> DataFrame:
    """The field sets that a batch goes by: those that were there when it first ran."""
    path = f"{out_dir.rstrip('/')}/_field_sets/batch={batch_id}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(done):
        rows = spark.read.schema(_SOURCE_SETS).parquet(source_sets)
        sets = fold_fields(rows, "source", "pos", msg_key=msg_key).select(
            "source", render_prefix("fields", msg_key).alias("front"), "error"
        )
        sets.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(_FRONTS).parquet(path)


def captured_field_sets(spark: SparkSession, out_dir: str) -> DataFrame:
    """Which fields each batch of `capture` gave its sources: `batch`, `source`, `front`, `error`."""
    table = spark.read.schema(f"{_FRONTS}, batch bigint")
    return table.parquet(f"{out_dir.rstrip('/')}/_field_sets").select("batch", "source", "front", "error")


def _write_ledger(
    spark: SparkSession, out_dir: str, batch_id: int, counts: dict[str, dict[str, int]]
) -> None:
    rows = [(name, row["rows"], row["bytes"]) for name, row in counts.items()]
    table = spark.createDataFrame(rows, _LEDGER).coalesce(1)
    table.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/_ledger/batch={batch_id}")


def captured_ledger(spark: SparkSession, out_dir: str, per_batch: bool = False) -> DataFrame:
    """What `capture` has counted under `out_dir` so far, over all its runs: `name`, `rows`, `bytes`.

    The counts are those of `captured_totals`, from a table that every batch writes to, so
    they survive restarts and need no process that has seen the runs. A batch that
    runs again overwrites its own rows. `per_batch` gives the rows of each `batch`.
    """
    table = spark.read.schema(f"{_LEDGER}, batch bigint").parquet(f"{out_dir.rstrip('/')}/_ledger")
    if per_batch:
        return table
    return table.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def capture(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    fields: FieldSet | Iterable[str] = (),
    max_len: int = DEFAULT_CHUNK,
    policy: str = "wait",
    buffer_size: int = DEFAULT_BUFFER,
    capacity: int | None = None,
    width: str = "1 minute",
    unit: str = "char",
    delimiter: str = "\n",
    msg_key: str = MESSAGE_KEY,
    checkpoint_dir: str | None = None,
    trigger: dict | None = None,
    dry_run: bool = False,
    ledger: bool = False,
    source_sets: str | None = None,
    source_pattern: str = r"([^/]+)/[^/]*$",
) -> StreamingQuery | None:
    """Start the streaming job that turns text files of `in_dir` into NDJSON files of `out_dir`.

    Wrong arguments and wrong fields raise before anything is written; a dry run
    stops there and returns None. A micro-batch takes at most `buffer_size`
    files. With `policy="wait"` the rest waits at the source. With
    `policy="drop"` only the first `capacity` lines of every `width` of file
    time are kept, and lines of files more than ten minutes older than those of
    earlier batches are dropped; both are counted. Its records are in one folder
    per batch, which a batch that runs again overwrites. The query ends with the present input, and goes on from its
    checkpoint when it is started again. `captured_totals` audits the run.

    With `ledger`, and always with `policy="drop"`, the records of each batch are in a folder of
    their own, and beside them the counts of every batch are written; `captured_ledger`
    adds them up over all runs.

    `source_sets` names a Parquet table of `source`, `pos` and `kv`: every source has its own
    fields, in place of `fields`. The source of a line is what the first group of
    `source_pattern` finds in the path of its file, the name of its folder unless stated
    otherwise. A batch reads the table as it is when the batch first runs, and keeps
    what it has read beside its records: a set that changes later changes later
    records only, also when the batch runs again. Sources without a set, or with a
    wrong one, keep their messages; see `captured_field_sets` for the errors.
    """
    constant = FieldSet.of(fields, check_key(msg_key))
    if source_sets is not None and constant.fields:
        raise ValueError("give fields or source_sets, not both")
    check_range("max_len", max_len, MIN_CHUNK, MAX_CHUNK)
    check_range("buffer_size", buffer_size, MIN_BUFFER, MAX_BUFFER)
    check_choice("policy", policy, POLICIES)
    check_unit(unit, max_len)
    if policy == "drop":
        check_range("capacity", capacity, 1)
    if not out_dir:
        raise ValueError("out_dir must not be empty")
    if dry_run:
        return None

    _listen(spark)
    lines = stream_lines(spark, in_dir, max_files=buffer_size, delimiter=delimiter)
    checkpoint = checkpoint_dir or f"{out_dir.rstrip('/')}/_checkpoint"
    run = {"availableNow": True} if trigger is None else trigger

    def records(kept: DataFrame) -> DataFrame:
        pieces = _counted(cap_lines(kept, max_len, unit, "value"), "pieces", "value")
        return _counted(
            encode_ndjson(pieces, "value", constant, msg_key).select("json"), "records", "json"
        )

    totals: dict[str, dict[str, int]] = {}
    used = ["value"] if source_sets is None else ["value", "source"]

    def with_source(rows: DataFrame, path: Column) -> DataFrame:
        # Paths are URLs, in which a plus stands for itself.
        found = F.replace(F.regexp_extract(path, source_pattern, 1), F.lit("+"), F.lit("%2B"))
        return rows if source_sets is None else rows.withColumn("source", F.try_url_decode(found))

    def write_batch(kept: DataFrame, batch_id: int) -> dict[str, dict[str, int]]:
        """Write the records of a batch, and count its lines, pieces and records on the way."""
        seen = {name: Observation(name) for name in ("lines", "pieces", "records")}
        text = kept.select(*used).observe(seen["lines"], *_sums("value"))
        pieces = cap_lines(text, max_len, unit, "value").observe(seen["pieces"], *_sums("value"))
        front = constant
        if source_sets is not None:
            sets = _sets_of_batch(spark, out_dir, batch_id, source_sets, msg_key)
            pieces = join_field_sets(pieces, sets.drop("error"), "source")
            front = F.col("front")
        encoded = encode_ndjson(pieces, "value", front, msg_key).select("json")
        (
            encoded.observe(seen["records"], *_sums("json"))
            .write.mode("overwrite")
            .option("lineSep", "\n")
            .text(f"{out_dir}/batch={batch_id}")
        )
        return {name: seen[name].get for name in seen}

    def settle_counts(counts: dict[str, dict[str, int]], batch_id: int) -> None:
        _write_ledger(spark, out_dir, batch_id, counts)
        for name, row in counts.items():
            _add(totals, name, row)

    if policy == "wait" and (ledger or source_sets is not None):
        located = lines.select("value", F.col("_metadata.file_path").alias("path"))
        arriving = with_source(located, F.col("path"))
        query = (
            arriving.select(*used).writeStream.foreachBatch(lambda b, n: settle_counts(write_batch(b, n), n))
            .option("checkpointLocation", checkpoint)
            .trigger(**run)
            .start()
        )
        _of_run(str(query.runId))
        _TOTALS[str(query.runId)] = totals
        return query
    if policy == "wait":
        return (
            records(_counted(lines, "lines", "value"))
            .writeStream.format("text")
            .option("lineSep", "\n")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**run)
            .start(out_dir)
        )

    arrivals = lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("path"),
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        # The place of a line in the batch; lines of a file are read in order. Written
        # once, so that places do not change between the jobs of a batch.
        place = F.monotonically_increasing_id()
        rows = with_source(batch.withColumn("place", place), F.col("path"))
        rows = settled(rows, "capture-batch")

        def write(kept: DataFrame, batch_id: int) -> None:
            counts = write_batch(kept, batch_id)
            arrived = rows.agg(*_sums("value")).first().asDict()
            counts["arrived"] = arrived
            counts["dropped"] = {k: arrived[k] - counts["lines"][k] for k in ("rows", "bytes")}
            settle_counts(counts, batch_id)

        order = ["arrived", "path", "place"]
        shed_batch(
            rows, batch_id, f"{out_dir.rstrip('/')}/_shed", "arrived", width, order, capacity,
            "10 minutes", write,
        )

    query = (
        arrivals.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**run)
        .start()
    )
    _of_run(str(query.runId))
    _TOTALS[str(query.runId)] = totals
    return query
