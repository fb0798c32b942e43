"""Re-assembly with timeouts: open lines of idle streams, late chunks, restarts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom import reassemble_timed
from logloom.streaming.timed import END, FEED, LATE, SIZE, TIMEOUT, _Lines, _Open

CHUNKS = "id string, seq bigint, data string, ts timestamp"


def at(minute):
    return datetime(2024, 1, 1, minute // 60, minute % 60)


def run(spark, base, rows, schema=CHUNKS, **options):
    """One more delivery; the query starts from its checkpoint and ends with the input."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(schema).parquet(f"{base}/in")
    pieces = reassemble_timed(source, "ts", "10 minutes", stream="id", **options)
    query = (
        pieces.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    query.awaitTermination()
    held = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    found = spark.read.schema(pieces.schema).parquet(f"{base}/out").withColumn(
        "started", F.unix_seconds("started") - int(at(0).timestamp())
    )
    return held, {tuple(row) for row in found.collect()}


def test_idle_streams_end_and_late_chunks_are_reported(spark, tmp_path):
    first = [("a", 0, "one\ntw", at(0)), ("b", 0, "open", at(0)), (None, 0, "nul\n", at(1))]
    held, found = run(spark, tmp_path, first, max_len=10)
    assert found == {("a", 0, 0, 0, "one", 0, FEED), (None, 60, 0, 0, "nul", 0, FEED)}
    # Continued in time, out of order within the delivery, after a restart.
    second = [("c", 1, "y\n", at(4)), ("a", 1, "o\nthree", at(2)), ("c", 0, "x" * 25, at(3))]
    _, found = run(spark, tmp_path, second, max_len=10)
    assert ("a", 0, 1, 0, "two", 1, FEED) in found
    assert {r[2:] for r in found if r[0] == "c"} == {
        (0, 0, "x" * 10, 0, SIZE), (0, 1, "x" * 10, 0, SIZE), (0, 2, "xxxxxy", 1, FEED)
    }
    assert not any(row[-1] == TIMEOUT for row in found)
    held, found = run(spark, tmp_path, [("d", 0, "later", at(60))], max_len=10)
    timed = {row for row in found if row[-1] == TIMEOUT}
    assert timed == {("a", 0, 2, 0, "three", 1, TIMEOUT), ("b", 0, 0, 0, "open", 0, TIMEOUT)}
    # The state of all idle streams is gone.
    assert held == 1
    fourth = [("b", 1, " tail\n", at(1)), ("a", 2, "new\n", at(60)), ("d", 1, "!", at(61)), ("d", 2, None, at(61))]
    _, found = run(spark, tmp_path, fourth, max_len=10)
    assert ("b", 60, None, None, " tail\n", 1, LATE) in found
    assert ("a", 3600, 0, 0, "new", 2, FEED) in found
    assert ("d", 3600, 0, 0, "later!", 2, END) in found
    assert len(found) == 11


def test_binary_chunks_and_wrong_input(spark, tmp_path):
    schema = "id int, seq bigint, data binary, ts timestamp"
    rows = [(1, 0, bytearray(b"\xff\n\xc3"), at(0)), (1, 1, bytearray(b"\xa9"), at(0)), (2, 0, None, at(0))]
    rows += [(9, 0, bytearray(b"\n"), at(60))]
    _, found = run(spark, tmp_path / "ok", rows, schema)
    assert {(r[0], bytes(r[4]), r[6]) for r in found} == {
        (1, b"\xff", FEED), (1, b"\xc3\xa9", TIMEOUT), (9, b"", FEED)
    }
    with pytest.raises(Exception, match="must not be NULL"):
        run(spark, tmp_path / "null", [("a", None, "x", at(0))])
    with pytest.raises(Exception, match="comes after"):
        run(spark, tmp_path / "twice", [("a", 1, "x", at(0)), ("a", 1, "x", at(0))])
    rates = spark.readStream.format("rate").load().withColumnRenamed("value", "line")
    with pytest.raises(ValueError):
        reassemble_timed(rates, "timestamp", stream="line", seq="line", data="line")


def test_pieces_of_a_line(spark):
    line = _Open(4, "", 0, 0, 7)
    for part in ("ab", "cdef", "ghi"):
        line.add(part, 1)
    line.close(2, FEED)
    line.add("wxyz", 3)
    line.close(3, FEED)
    line.close(4, FEED)
    line.close(5, END)
    assert [(p[1], p[2], p[3], p[5]) for p in line.pieces] == [
        (0, 0, "abcd", SIZE), (0, 1, "efgh", SIZE), (0, 2, "i", FEED), (1, 0, "wxyz", SIZE), (2, 0, "", FEED)
    ]
    assert isinstance(_Lines(4, 1, ["id"]).row("k", *range(6)).line_no, int)
