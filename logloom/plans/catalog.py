"""Every operator as a query over the test tables.

Each query takes the session and the folder of the tables, and works on whole
tables. Queries about files and streams write to the shared scratch folder and
return what they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import operators as op
from ..functions.cuts import text_length
from ..sinks import write_ndjson
from ..sources import read_lines, stream_lines
from ..session import scratch_dir
from ..streaming import (
    read_reassembled,
    read_shed,
    reassemble_stream,
    reassemble_timed,
    shed_stream,
    shed_stream_report,
)
from ..limits import MAX_BUFFER
from .capture import capture, capture_frame, captured_ledger, captured_totals
from .samples import (
    CONTROL_FROM,
    CONTROL_TO,
    ESCAPED_FROM,
    ESCAPED_TO,
    FOLD_KV,
    NUL_FROM,
    PARSE_KV,
    RUN_FIELDS,
    SOURCE_KV,
    TYPED_FIELDS,
)

LINE_KEYS = ["doc_id", "line_no"]
RECORD = "\x1e"
# Bytes of text that a task writes to files in order, about, and such tasks at least.
RANGE_BYTES, RANGES = 16 << 20, 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return op.split_lines(documents, ["doc_id", "source"], "text")


def _events_kv(spark: SparkSession, sf_dir: str, kv_sql: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("kv", F.expr(kv_sql))


def _hour() -> Column:
    return F.substring(F.col("ts").cast("string"), 1, 13).alias("hour")


# Lines, chunks and re-assembly.


def q_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")


def q_cap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cap_lines(_lines(spark, sf_dir).drop("source"), 1024)


def q_cap_lines_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cap_lines(_lines(spark, sf_dir).drop("source"), 100, unit="byte")


def q_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 1024)


def q_chunk_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 1024, "byte")
    return chunks.select("doc_id", "seq", F.hex("data").alias("data_hex"))


def q_reassemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 64)
    return op.reassemble_lines(chunks, "doc_id", max_len=None)


def q_reassemble_lines_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 1024, "byte")
    return op.reassemble_lines(chunks, "doc_id", max_len=None)


def q_reassemble_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 300)
    return op.reassemble_lines(chunks, "doc_id", max_len=200)


def q_reassemble_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a language are one stream, numbered by the place of their first character."""
    documents = _table(spark, sf_dir, "documents")
    chunks = op.chunk_text(documents, ["lang", "doc_id"], "text", 300)
    place = F.col("doc_id") * 10_000_000 + F.col("seq") * 300
    return op.reassemble_lines(chunks.withColumn("place", place), "lang", "place", max_len=200)


def q_reassemble_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams per language and number in five; one language has no id."""
    documents = _table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "doc_id", "text"
    )
    chunks = op.chunk_text(documents, ["lang", "doc_id"], "text", 200)
    return op.reassemble_lines(chunks, ["lang", "doc_id"], max_len=1000)


def q_cut_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 37 bytes as texts, which may begin and end inside a character."""
    blocks = op.chunk_text(_table(spark, sf_dir, "documents"), "doc_id", "text", 37, "byte")
    texts = blocks.withColumn("data", F.col("data").cast("string"))
    pieces = op.cap_lines(op.split_lines(texts, ["doc_id", "seq"], "data"), 10, unit="byte")
    return pieces.select("doc_id", "seq", "line_no", "piece_no", F.hex("line").alias("line_hex"))


def q_reassemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks arrive in three deliveries; the query stops and is started again after each."""
    base = scratch_dir(spark, "reassemble")
    documents = _table(spark, sf_dir, "documents")
    # The end follows the last chunk, in the same pass over the texts; one without any has no end.
    numbered = documents.withColumn("n", F.ceil(text_length(F.col("text")) / 700))
    chunks = op.chunk_text(numbered, ["doc_id", "n"], "text", 700)
    here = F.struct("seq", "data")
    end = F.struct(F.col("n").alias("seq"), F.lit(None).cast("string").alias("data"))
    last = F.col("seq") + 1 == F.col("n")
    ended = chunks.select(
        "doc_id", F.inline(F.when(last, F.array(here, end)).otherwise(F.array(here)))
    )
    seq = F.col("seq")
    for delivery in (seq < 2, (seq >= 2) & (seq < 6), seq >= 6):
        ended.filter(delivery).write.mode("append").parquet(f"{base}/chunks")
        arriving = spark.readStream.schema(ended.schema).parquet(f"{base}/chunks")
        reassemble_stream(
            arriving, f"{base}/lines", f"{base}/checkpoint", "doc_id", max_len=200
        ).awaitTermination()
    return read_reassembled(spark, f"{base}/lines", [ended.schema["doc_id"]])


def q_reassemble_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that go idle: the rest of some comes after the timeout, that of others too late.

    The documents of every 97 numbers are the chunks of a stream. They arrive in deliveries an
    hour apart, and a mark of its own stream moves the time on; the query stops and is
    started again after each. One stream in five has what follows its first third a
    delivery later than the others, and one in five has it then with the times of the first.
    """
    base = scratch_dir(spark, "timed")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    third = documents.agg(F.max("doc_id")).first()[0] // 3
    stream, rest = F.pmod("doc_id", F.lit(97)), F.col("doc_id") > third
    slow = rest & (stream % 5 <= 1)
    turn = F.when(slow, 2).when(rest, 1).otherwise(0)
    hour = F.when(slow & (stream % 5 == 1), 0).otherwise(turn)
    chunks = documents.select(
        stream.alias("stream_id"),
        F.col("doc_id").alias("seq"),
        F.coalesce("text", F.lit("")).alias("data"),
        turn.alias("turn"),
        F.timestamp_seconds(hour.cast("bigint") * 3600).alias("ts"),
    )
    number = F.col("id")
    marks = spark.range(4).select(
        F.lit(-1).cast("bigint").alias("stream_id"),
        number.alias("seq"),
        F.lit(None).cast("string").alias("data"),
        number.cast("int").alias("turn"),
        F.timestamp_seconds(number * 3600 + 300).alias("ts"),
    )
    arriving = chunks.unionByName(marks)
    for delivery in range(4):
        arriving.filter(F.col("turn") == delivery).drop("turn").write.mode("append").parquet(
            f"{base}/chunks"
        )
        source = spark.readStream.schema(arriving.drop("turn").schema).parquet(f"{base}/chunks")
        pieces = reassemble_timed(source, "ts", "10 minutes", max_len=1000)
        (
            pieces.writeStream.format("parquet")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{base}/lines")
            .awaitTermination()
        )
    late = F.col("ended_by") == "late"
    return spark.read.schema(pieces.schema).parquet(f"{base}/lines").select(
        "stream_id",
        F.hour("started").cast("bigint").alias("hour"),
        "line_no", "piece_no", "line", "ended_by",
        F.when(late, F.col("seq")).alias("late_seq"),
    )


# Metadata fields.


def q_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = op.parse_fields(_events_kv(spark, sf_dir, PARSE_KV), "kv")
    return parsed.select("event_id", "key", "val", "error")


def q_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = op.parse_fields(_events_kv(spark, sf_dir, PARSE_KV), "kv")
    return op.type_profile(parsed, ["event_type", "key"], "val")


def q_fold_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = op.fold_fields(_events_kv(spark, sf_dir, FOLD_KV), "user_id", "event_id")
    return folded.select(
        "user_id",
        F.when(F.col("error").isNull(), op.render_prefix("fields")).alias("prefix"),
        "error",
        "error_pos",
    )


def q_validate_field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.validate_field_sets(_events_kv(spark, sf_dir, FOLD_KV), "user_id", "event_id").select(
        "user_id", "ok", "error", "error_pos", F.col("n_fields").cast("bigint").alias("n_fields")
    )


def q_inject_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "event_type")
    return op.inject_fields(events, TYPED_FIELDS)


def q_join_field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _events_kv(spark, sf_dir, SOURCE_KV)
    sets = op.fold_fields(kv, "event_type", "event_id").select(
        "event_type", op.render_prefix("fields").alias("front")
    )
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    joined = op.join_field_sets(events, sets, "event_type")
    return op.encode_ndjson(joined, "props", F.col("front")).select("event_id", "json")


def q_join_field_sets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source has no set, and one has a set that failed."""
    kind = F.col("event_type")
    kv = _events_kv(spark, sf_dir, SOURCE_KV).filter(kind != "click")
    kv = kv.withColumn("kv", F.when(kind == "view", F.lit("=")).otherwise(F.col("kv")))
    sets = op.fold_fields(kv, "event_type", "event_id").select(
        "event_type", op.render_prefix("fields").alias("front"), "error"
    )
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    joined = op.join_field_sets(events, sets, "event_type")
    return op.encode_ndjson(joined, "props", F.col("front")).select("event_id", "json", "error")


# Encoding.


def q_encode_ndjson_line_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message under another key, which sets the usual one free for a field."""
    turns = _table(spark, sf_dir, "conversations")
    encoded = op.encode_ndjson(turns, "text", ["msg=1", "app=chat"], msg_key="line")
    return encoded.select("conv_id", "turn", "json")


def q_encode_ndjson_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op.split_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return op.encode_ndjson(lines, "line", RUN_FIELDS).select(*LINE_KEYS, "json")


def q_encode_ndjson_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return op.encode_ndjson(pages, "html", RUN_FIELDS).select("page_id", "json")


def _with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters turned into the control characters that the texts lack."""
    controls = F.translate("text", CONTROL_FROM, CONTROL_TO)
    text = F.replace(controls, F.lit(NUL_FROM), F.lit("\x00"))
    return _table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def _with_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters turned into quotes, backslashes and frequent controls."""
    text = F.translate("text", ESCAPED_FROM, ESCAPED_TO)
    return _table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def q_encode_ndjson_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.encode_ndjson(_with_escapes(spark, sf_dir), "text").select("doc_id", "json")


def q_encode_ndjson_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.encode_ndjson(_with_controls(spark, sf_dir), "text").select("doc_id", "json")


def q_encode_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    encoded = op.encode_with(turns, "text", op.csv_encoder(), ["app=chat", "run=7"])
    return encoded.select("conv_id", "turn", "record")


def q_truncate_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return op.truncate_encoded(pages, "html", 256).select("page_id", "encoded")


def q_truncate_encoded_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.truncate_encoded(_with_controls(spark, sf_dir), "text", 99).select(
        "doc_id", "encoded"
    )


# Flow control.


def q_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(_hour(), "ts", "event_id", "event_type")
    return op.shed(events, "hour", ["ts", "event_id"], 8).select("hour", "event_id", "event_type")


def q_shed_large_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return op.shed(events, "event_type", ["ts", "event_id"], 1500).select("event_type", "event_id")


def q_shed_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal orders in every bucket: how many rows stay, and which orders they have."""
    documents = _table(spark, sf_dir, "documents").select(
        "source", F.expr("coalesce(char_length(text), 0) div 500").alias("size"), "doc_id", "lang"
    )
    kept = op.shed(documents, "source", "size", 30)
    return kept.groupBy("source", "size").agg(
        F.count(F.lit(1)).alias("kept"), F.countDistinct("doc_id").alias("ids")
    )


def q_shed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shed_report(_table(spark, sf_dir, "events").select(_hour()), "hour", 8)


def _delivered(spark: SparkSession, sf_dir: str, base: str, deliveries):
    """Write the events in deliveries; yield the stream after each. Each is one micro-batch."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for delivery in deliveries:
        events.filter(delivery).write.mode("append").parquet(f"{base}/events")
        yield spark.readStream.schema(events.schema).parquet(f"{base}/events")


def _in_order() -> list[Column]:
    day = F.dayofmonth("ts")
    return [day <= 10, (day > 10) & (day <= 20), day > 20]


def _out_of_order() -> list[Column]:
    """One event in four of the first days is delivered with those of the following ones."""
    day, slow = F.dayofmonth("ts"), F.col("event_id") % 4 == 0
    return [(day <= 10) & ~slow, (day <= 20) & ((day > 10) | slow), day > 20]


def _shed_in(spark: SparkSession, sf_dir: str, deliveries: list[Column]) -> tuple[str, StructType]:
    base = scratch_dir(spark, "shed")
    for arriving in _delivered(spark, sf_dir, base, deliveries):
        shed_stream(
            arriving, f"{base}/shed", f"{base}/checkpoint", "ts", "1 hour", ["ts", "event_id"], 8
        ).awaitTermination()
    return f"{base}/shed", arriving.schema


def _kept_rows(spark: SparkSession, sf_dir: str, deliveries: list[Column]) -> DataFrame:
    out, schema = _shed_in(spark, sf_dir, deliveries)
    return read_shed(spark, out, schema).select(_hour(), "event_id", "event_type")


def q_shed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_rows(spark, sf_dir, _in_order())


def q_shed_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_rows(spark, sf_dir, _out_of_order())


def _report(spark: SparkSession, out: str) -> DataFrame:
    hour = F.substring(F.col("bucket").cast("string"), 1, 13).alias("hour")
    return shed_stream_report(spark, out).select(hour, "arrived", "kept", "dropped", "late")


def q_shed_stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = _shed_in(spark, sf_dir, _in_order())
    return _report(spark, out).drop("late")


def q_shed_stream_late_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = _shed_in(spark, sf_dir, _out_of_order())
    return _report(spark, out)


# Files, the whole job, and audits.


def _line_files(spark: SparkSession, sf_dir: str, base: str) -> str:
    _lines(spark, sf_dir).select("line").write.text(f"{base}/in")
    return f"{base}/in"


def q_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, _line_files(spark, sf_dir, scratch_dir(spark, "lines")))


def q_read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, line feeds and all, as records that end in 0x1E."""
    base = scratch_dir(spark, "records")
    texts = _table(spark, sf_dir, "documents").select("text")
    texts.write.option("lineSep", RECORD).text(f"{base}/in")
    return read_lines(spark, f"{base}/in", delimiter=RECORD)


def q_stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "stream")
    lines = stream_lines(spark, _line_files(spark, sf_dir, base), max_files=4)
    (
        lines.writeStream.format("text")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out")
        .awaitTermination()
    )
    return read_lines(spark, f"{base}/out")


def q_write_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "ndjson")
    documents = _table(spark, sf_dir, "documents")
    pieces = op.cap_lines(op.split_lines(documents, "doc_id", "text"), 1024)
    write_ndjson(
        pieces, f"{base}/out", [*LINE_KEYS, "piece_no"], max_records_per_file=5000,
        encode=lambda rows: op.encode_ndjson(rows, "line", RUN_FIELDS),
    )
    return read_lines(spark, f"{base}/out").withColumnRenamed("value", "json")


def q_write_ndjson_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of at most 200,000 bytes, and whether their records are in order when read again."""
    base, cap, keys = scratch_dir(spark, "ndjson-bytes"), 200_000, [*LINE_KEYS, "piece_no"]
    pieces = op.cap_lines(op.split_lines(_table(spark, sf_dir, "documents"), "doc_id", "text"), 1024)

    def encoded(rows: DataFrame) -> DataFrame:
        front = op.render_prefix(_fields([(key, F.col(key)) for key in keys]))
        return op.encode_ndjson(rows.withColumn("front", front), "line", F.col("front"))

    write_ndjson(pieces, f"{base}/out", keys, max_bytes_per_file=cap, encode=encoded)
    types = ", ".join(f"{key} bigint" for key in keys)
    written = read_lines(spark, f"{base}/out", with_places=True).select(
        "path", F.col("line_no").alias("place"),
        (F.octet_length("value").cast("bigint") + 1).alias("bytes"),
        F.struct(F.from_json("value", types).alias("key")).alias("at"),
    )
    # In a file every record follows the one before it; so do the files, of which there are few.
    here = Window.partitionBy("path").orderBy("place")
    files = (
        written.withColumn("back", (F.lag("at").over(here) >= F.col("at")).cast("bigint"))
        .groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum("back").alias("back"),
            F.min("at").alias("first"), F.max("at").alias("last"),
        )
    )
    follows = F.lag("last").over(Window.orderBy("path")) < F.col("first")
    return files.withColumn("wrong", (~follows).cast("bigint")).agg(
        F.sum("n").alias("records"),
        F.sum("b").alias("bytes"),
        F.count_if((F.col("b") > cap) & (F.col("n") > 1)).alias("files_over"),
        (F.coalesce(F.sum("back"), F.lit(0)) + F.coalesce(F.sum("wrong"), F.lit(0))).alias("unordered"),
    )


def q_read_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files per language, its texts in the order of their numbers; which place each has."""
    base = scratch_dir(spark, "places")
    documents = _table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    # Ranges of about as many rows each: a language may be most of the table.
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES, -(-size // RANGE_BYTES))
    (
        documents.repartitionByRange(ranges, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
        .select("lang", F.coalesce("text", F.lit("")).alias("text"))
        .write.partitionBy("lang").option("lineSep", RECORD).text(f"{base}/in")
    )
    places = read_lines(spark, f"{base}/in", RECORD, with_places=True, per_folder=True)
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    return places.select(lang.alias("lang"), "line_no", F.col("value").alias("text"))


def q_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "capture")
    source = _line_files(spark, sf_dir, base)
    capture(spark, source, f"{base}/out", RUN_FIELDS, max_len=1024).awaitTermination()
    return read_lines(spark, f"{base}/out").withColumnRenamed("value", "json")


def q_capture_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of two runs, the second of which finds more files."""
    base = scratch_dir(spark, "ledger")
    lines = _lines(spark, sf_dir)
    for turn in range(2):
        lines.filter(F.pmod("doc_id", F.lit(2)) == turn).select("line").write.mode("append").text(
            f"{base}/in"
        )
        capture(
            spark, f"{base}/in", f"{base}/out", RUN_FIELDS, max_len=1024, ledger=True
        ).awaitTermination()
    return captured_ledger(spark, f"{base}/out")


def q_capture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields per source, of which some change, and one set breaks, before the second delivery."""
    base = scratch_dir(spark, "sources")
    lines = _lines(spark, sf_dir)
    sources = lines.select("source").distinct().filter("source <> ''")
    number = F.substring("source", -1, 1)
    for turn in range(2):
        run = F.when((number == "3") & F.lit(turn == 1), "run=2").otherwise("run=1")
        broken = (number == "4") & F.lit(turn == 1)
        sources.select(
            "source",
            F.explode(
                F.array(
                    F.struct(F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("origin="), "source").alias("kv")),
                    F.struct(F.lit(1).cast("bigint").alias("pos"), F.when(broken, "=").otherwise(run).alias("kv")),
                )
            ).alias("set"),
        ).select("source", "set.*").write.mode("overwrite").parquet(f"{base}/sets")
        lines.filter(F.pmod("doc_id", F.lit(2)) == turn).select("source", "line").write.mode(
            "append"
        ).partitionBy("source").text(f"{base}/in")
        capture(
            spark, f"{base}/in", f"{base}/out", max_len=1024, source_sets=f"{base}/sets",
            source_pattern=r"/source=([^/]*)/[^/]*$", buffer_size=MAX_BUFFER,
        ).awaitTermination()
    return read_lines(spark, f"{base}/out").select(F.col("value").alias("json"))


def q_capture_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against the lines themselves; in one source, two lines of a length have changed places."""
    lines = _lines(spark, sf_dir)
    place = F.struct("doc_id", "line_no")
    pairs = lines.filter((F.col("source") == "src3") & (F.length("line") > 0)).groupBy(
        F.octet_length("line").alias("n")
    ).agg(F.min_by("line", place).alias("a"), F.max_by("line", place).alias("b"))
    pair = pairs.filter("a <> b").orderBy(F.desc("n")).limit(1)
    wrong = lines.join(F.broadcast(pair), F.lit(True), "left").withColumn(
        "line",
        F.when(F.col("source") != "src3", F.col("line"))
        .when(F.col("line") == F.col("a"), F.col("b"))
        .when(F.col("line") == F.col("b"), F.col("a"))
        .otherwise(F.col("line")),
    )
    records = op.encode_ndjson(op.cap_lines(wrong.drop("n", "a", "b"), 1024), "line", RUN_FIELDS)
    found = op.capture_audit(lines, records, "source", line_key=LINE_KEYS, max_len=1024)
    return found.select("source", "lines", "pieces", "bytes_in", "balanced")


def q_capture_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a capture that drops says of itself: the lines are in one bucket of file time."""
    base = scratch_dir(spark, "capture-drop")
    source = _line_files(spark, sf_dir, base)
    query = capture(
        spark, source, f"{base}/out", RUN_FIELDS, max_len=1024, policy="drop", capacity=1000,
        width="36500 days", buffer_size=MAX_BUFFER,
    )
    query.awaitTermination()
    totals = captured_totals(query)
    written = read_lines(spark, f"{base}/out").agg(F.count(F.lit(1)).alias("written"))
    return written.select(
        *[F.lit(totals[name]["rows"]).cast("bigint").alias(name) for name in ("arrived", "dropped", "lines")],
        (F.lit(totals["records"]["rows"]) - F.col("written")).alias("unwritten"),
    )


def q_capture_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return capture_frame(documents, "doc_id", "text", RUN_FIELDS, 1024)


def q_capture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = capture_frame(
        _with_escapes(spark, sf_dir), ["doc_id", "source"], "text", RUN_FIELDS, 1024
    )
    raw = op.split_lines(_with_escapes(spark, sf_dir), "source", "text")
    return op.capture_audit(raw, records, "source")


def q_written_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against the lines that went into them; the records of one source lack some."""
    base = scratch_dir(spark, "audit")
    documents = _table(spark, sf_dir, "documents")
    raw = op.split_lines(documents, ["doc_id", "source"], "text")
    records = op.encode_ndjson(
        op.cap_lines(raw, 1024).withColumn("front", op.render_prefix(_own_fields())),
        "line", F.col("front"),
    )
    lost = (F.col("source") == "src3") & (F.col("doc_id") % 3 == 0) & (F.col("line_no") == 0)
    write_ndjson(records.filter(~lost), f"{base}/out", [*LINE_KEYS, "piece_no"])
    fields = "source string, piece bigint"
    written = read_lines(spark, f"{base}/out").select(
        F.from_json("value", fields).alias("r"), F.col("value").alias("json")
    )
    written = written.select("r.source", F.col("r.piece").alias("piece_no"), "json")
    return op.capture_audit(raw, written, "source").drop("growth")


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """Columns of a record as its fields."""
    return F.array(
        *[
            F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), val.cast("string").alias("val"))
            for pos, (key, val) in enumerate(pairs)
        ]
    )


def _own_fields() -> Column:
    """The source and the piece number of a record, as its fields."""
    return _fields([("source", F.col("source")), ("piece", F.col("piece_no"))])


def q_escape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.escape_profile(_lines(spark, sf_dir), "line", "source")


def q_escape_profile_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.escape_profile(_with_controls(spark, sf_dir), "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name.removeprefix("q_"): query
        for name, query in globals().items()
        if name.startswith("q_")
    }
