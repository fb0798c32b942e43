"""Files in and out, and streams against the same work on tables."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import (
    FieldError,
    capture,
    captured_field_sets,
    captured_ledger,
    captured_totals,
    read_lines,
    read_reassembled,
    read_shed,
    reassemble_lines,
    reassemble_stream,
    shed,
    shed_stream,
    shed_stream_report,
    stream_lines,
    write_ndjson,
)
from logloom.plans import catalog
from logloom.session import scratch_dir

CHUNKS = "stream_id string, seq bigint, data string"


def put(folder: Path, name: str, data: bytes) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def values(frame):
    return sorted(row[0] for row in frame.collect())


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_only_the_delimiter_separates(spark, tmp_path):
    put(tmp_path / "lf", "a.txt", b"a\r\nb\rc\n\nd")
    assert values(read_lines(spark, str(tmp_path / "lf"))) == ["", "a\r", "b\rc", "d"]
    put(tmp_path / "rs", "a.bin", b"one\nmore\x1etwo\x1e")
    assert values(read_lines(spark, str(tmp_path / "rs"), "\x1e")) == ["one\nmore", "two"]
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path / "lf"), "\r\n")


def test_stream_takes_bounded_batches_and_loses_nothing(spark, tmp_path):
    for i in range(7):
        put(tmp_path / "in", f"{i}.txt", f"line {i}\n".encode() * (i + 1))
    query = (
        stream_lines(spark, str(tmp_path / "in"), max_files=2)
        .writeStream.format("text").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert [p["numInputRows"] > 0 for p in query.recentProgress].count(True) == 4
    assert values(read_lines(spark, str(tmp_path / "out"))) == values(read_lines(spark, str(tmp_path / "in")))
    with pytest.raises(ValueError):
        stream_lines(spark, str(tmp_path / "in"), max_files=1, max_bytes=1)


def test_write_ndjson_is_ordered_and_capped(spark, tmp_path):
    records = spark.range(25).select(
        (24 - F.col("id")).alias("n"), F.format_string("r%02d", 24 - F.col("id")).alias("json")
    )
    out = tmp_path / "out"
    write_ndjson(records.repartition(3), str(out), "n", max_records_per_file=10)
    files = sorted(out.glob("part-*"))
    texts = [f.read_text() for f in files]
    assert "".join(texts) == "".join(f"r{i:02d}\n" for i in range(25))
    assert all(t.count("\n") <= 10 for t in texts) and len(files) >= 3


def test_bytes_that_are_not_utf8_reach_the_files(spark, tmp_path):
    put(tmp_path / "in", "a.txt", b"c\xffd\n")
    capture(spark, str(tmp_path / "in"), str(tmp_path / "out")).awaitTermination()
    data = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    assert data == b'{"msg":"c\xffd"}\n'


def test_capture_restarts_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    long_line = "x" * 1024 + "y" * 10
    put(tmp_path / "in", "1.txt", f"one\n{long_line}\n\n".encode())
    capture(spark, source, out, ["run=1"], max_len=1024).awaitTermination()
    put(tmp_path / "in", "2.txt", b"two \"q\"\nopen")
    for _ in range(2):
        capture(spark, source, out, ["run=1"], max_len=1024).awaitTermination()
    assert values(read_lines(spark, out)) == sorted(
        '{"run":1,"msg":"%s"}' % m
        for m in ["one", "x" * 1024, "y" * 10, "", 'two \\"q\\"', "open"]
    )


def test_capture_drops_and_keeps_the_first_lines(spark, tmp_path):
    put(tmp_path / "in", "1.txt", "".join(f"{i}\n" for i in range(50)).encode())
    capture(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), policy="drop", capacity=4, width="3650 days"
    ).awaitTermination()
    assert values(read_lines(spark, str(tmp_path / "out"))) == ['{"msg":"%d"}' % i for i in range(4)]


def test_capture_counts_on_the_way(spark, tmp_path):
    put(tmp_path / "in", "1.txt", ("é" * 1030 + "\na\tb\n\n").encode())
    query = capture(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_len=1024)
    query.awaitTermination()
    totals = captured_totals(query)
    assert totals["lines"] == {"rows": 3, "bytes": 2063}
    assert totals["pieces"] == {"rows": 4, "bytes": 2063}
    out = read_lines(spark, str(tmp_path / "out"))
    written = out.agg(F.count("*"), F.sum(F.octet_length("value"))).first()
    assert totals["records"] == {"rows": written[0], "bytes": written[1]}


def test_capture_checks_before_it_writes(spark, tmp_path):
    out = tmp_path / "out"
    args = (spark, str(tmp_path), str(out))
    assert capture(*args, ["a=1"], dry_run=True) is None
    with pytest.raises(FieldError):
        capture(*args, ["bad key!=value"], dry_run=True)
    for wrong in (
        {"max_len": 1023}, {"max_len": 131073}, {"buffer_size": 0}, {"buffer_size": 1025},
        {"policy": "block"}, {"policy": "drop"}, {"unit": "line"},
    ):
        with pytest.raises(ValueError):
            capture(*args, **wrong)
    with pytest.raises(ValueError):
        capture(spark, str(tmp_path), "")
    assert not out.exists()


def run_reassembly(spark, base, deliveries, max_len):
    for rows in deliveries:
        spark.createDataFrame(rows, CHUNKS).write.mode("append").parquet(f"{base}/chunks")
        arriving = spark.readStream.schema(CHUNKS).parquet(f"{base}/chunks")
        query = reassemble_stream(arriving, f"{base}/lines", f"{base}/cp", max_len=max_len, span=2)
        query.awaitTermination()
    stream = [T.StructField("stream_id", T.StringType())]
    return lambda with_open=False: read_reassembled(spark, f"{base}/lines", stream, with_open)


@pytest.mark.parametrize("max_len", [4, 100])
def test_stream_reassembly_equals_the_table_form(spark, tmp_path, max_len):
    deliveries = [
        [("a", 0, "data"), ("a", 1, "da\nta"), ("b", 0, "xxxx"), ("c", 0, "1\n2\n\n3")],
        [("a", 2, "\ndata\n"), ("b", 1, "\n"), ("d", 0, "")],
        [("b", 2, "yyyyyyyy"), ("c", 1, "4")],
        [("b", 3, "\nz"), ("d", 1, "late\n")],
    ]
    read = run_reassembly(spark, str(tmp_path), deliveries, max_len)
    table = spark.createDataFrame([r for rows in deliveries for r in rows], CHUNKS)
    want = reassemble_lines(table, max_len=max_len)
    assert same(read(with_open=True), want)
    open_tails = {(r.stream_id, r.line) for r in read(True).exceptAll(read()).collect()}
    assert open_tails == {("b", "z"), ("c", "34")}


def test_end_of_stream_writes_the_open_line(spark, tmp_path):
    deliveries = [
        [("a", 0, "x\nop"), ("b", 0, "q\n"), ("c", 0, "r")],
        [("a", 1, "en"), ("a", 2, None), ("b", 1, None)],
    ]
    read = run_reassembly(spark, str(tmp_path), deliveries, 100)
    got = sorted((r.stream_id, r.line_no, r.line) for r in read().collect())
    assert got == [("a", 0, "x"), ("a", 1, "open"), ("b", 0, "q")]


def test_a_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    deliveries = [[("a", 0, "x\ny")], [("a", 1, "z\n")]]
    read = run_reassembly(spark, str(tmp_path), deliveries, 100)
    before = sorted(map(tuple, read().collect()))
    # Lose the commit of the last batch, as if the driver had died before it.
    commits = tmp_path / "cp" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()
    query = reassemble_stream(
        spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/chunks"),
        f"{tmp_path}/lines", f"{tmp_path}/cp", max_len=100,
    )
    query.awaitTermination()
    assert sorted(map(tuple, read().collect())) == before == [("a", 0, 0, "x"), ("a", 1, 0, "yz")]


def test_binary_chunks_may_break_inside_characters(spark, tmp_path):
    data = "é🧪é\nßß\n🧪".encode()
    schema = "stream_id string, seq bigint, data binary"
    rows = [("a", i, bytearray(data[i : i + 1])) for i in range(len(data))]
    for part in (rows[:3], rows[3:10], [*rows[10:], ("a", len(rows), None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/chunks")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/chunks")
        reassemble_stream(arriving, f"{tmp_path}/lines", f"{tmp_path}/cp").awaitTermination()
    stream = [T.StructField("stream_id", T.StringType())]
    got = read_reassembled(spark, f"{tmp_path}/lines", stream, binary=True).orderBy("line_no")
    assert [bytes(r.line).decode() for r in got.collect()] == ["é🧪é", "ßß", "🧪"]


def test_an_end_has_a_place_in_its_stream(spark, tmp_path):
    deliveries = [
        [("a", 0, "old"), ("a", 1, None), ("a", 2, "new\n"), (None, 0, "n")],
        [("a", 3, "more"), (None, 1, "o\n"), ("a", 4, None), ("a", 5, None), ("a", 6, "x\n")],
    ]
    read = run_reassembly(spark, str(tmp_path), deliveries, 100)
    got = sorted(((r.stream_id, r.line_no, r.line) for r in read().collect()), key=str)
    assert got == [("a", 0, "new"), ("a", 0, "old"), ("a", 0, "x"), ("a", 1, "more"), (None, 0, "no")]


EVENTS = "ts timestamp, n bigint"


def deliver(spark, base, rows):
    rows.write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(EVENTS).parquet(f"{base}/in")


def shed_all(spark, base, deliveries, capacity):
    for rows in deliveries:
        arriving = deliver(spark, base, rows)
        shed_stream(
            arriving, f"{base}/shed", f"{base}/cp", "ts", "1 hour", ["ts", "n"], capacity
        ).awaitTermination()
    return read_shed(spark, f"{base}/shed", arriving.schema), shed_stream_report(spark, f"{base}/shed")


def minutes(spark, low, high):
    return spark.range(low, high).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.col("id").alias("n")
    )


def test_stream_shedding_equals_the_table_form(spark, tmp_path):
    parts = [minutes(spark, low, high) for low, high in ((0, 100), (100, 290), (290, 600))]
    kept, report = shed_all(spark, str(tmp_path), parts, 7)
    hourly = minutes(spark, 0, 600).withColumn("bucket", F.date_trunc("hour", "ts"))
    assert same(kept.select("ts", "n", "bucket"), shed(hourly, "bucket", ["ts", "n"], 7).select("ts", "n", "bucket"))
    rows = report.collect()
    assert [(r.arrived, r.kept, r.dropped, r.late) for r in rows] == [(60, 7, 53, 0)] * 10


def test_late_rows_take_no_places(spark, tmp_path):
    """Four late rows of a closed bucket and four rows in time, in one batch."""
    first = minutes(spark, 60, 61)
    second = spark.createDataFrame(
        [(5 * 60 + k, k) for k in range(4)] + [(55 * 60 + k, 10 + k) for k in range(4)], "s bigint, n bigint"
    ).select(F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts"), "n")
    untimed = spark.createDataFrame([(None, 99)], EVENTS)
    kept, report = shed_all(spark, str(tmp_path), [first, second.unionByName(untimed)], 4)
    assert sorted(r.n for r in kept.collect()) == [10, 11, 12, 13, 60]
    counts = {str(r.bucket): (r.arrived, r.kept, r.dropped, r.late) for r in report.collect()}
    assert counts == {
        "2024-01-01 00:00:00": (8, 4, 4, 4), "2024-01-01 01:00:00": (1, 1, 0, 0), "None": (1, 0, 1, 1),
    }


def test_a_repeated_shedding_batch_replaces_its_own_rows(spark, tmp_path):
    base = str(tmp_path)
    kept, report = shed_all(spark, base, [minutes(spark, 0, 30), minutes(spark, 30, 70)], 40)
    before = sorted(map(str, kept.collect())), sorted(map(str, report.collect()))
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    arriving = spark.readStream.schema(EVENTS).parquet(f"{base}/in")
    shed_stream(arriving, f"{base}/shed", f"{base}/cp", "ts", "1 hour", ["ts", "n"], 40).awaitTermination()
    kept, report = read_shed(spark, f"{base}/shed", arriving.schema), shed_stream_report(spark, f"{base}/shed")
    assert (sorted(map(str, kept.collect())), sorted(map(str, report.collect()))) == before
    assert len(before[0]) == 50


def test_capture_counts_what_it_drops(spark, tmp_path):
    """A file an hour older than those of an earlier batch is late, and counted."""
    put(tmp_path / "in", "1.txt", b"a\nb\nc\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"))
    options = {"policy": "drop", "capacity": 2, "width": "3650 days"}
    query = capture(*args, **options)
    query.awaitTermination()
    totals = captured_totals(query)
    assert totals["arrived"] == {"rows": 3, "bytes": 3} and totals["dropped"] == {"rows": 1, "bytes": 1}
    put(tmp_path / "in", "2.txt", b"late\nlater\n")
    then = time.time() - 3600
    os.utime(tmp_path / "in" / "2.txt", (then, then))
    query = capture(*args, **options)
    query.awaitTermination()
    totals = captured_totals(query)
    assert totals["arrived"]["rows"] == totals["dropped"]["rows"] == 2 and totals["lines"]["rows"] == 0


def test_capture_keeps_bytes_of_long_lines(spark, tmp_path):
    line = b"x" * 1020 + b"\xff\xfe" + b"y" * 10
    put(tmp_path / "in", "a.txt", line + b"\n")
    query = capture(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_len=1024)
    query.awaitTermination()
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    assert data == b'{"msg":"' + line[:1024] + b'"}\n{"msg":"' + line[1024:] + b'"}\n'
    totals = captured_totals(query)
    assert totals["lines"]["bytes"] == totals["pieces"]["bytes"] == 1032


def test_totals_of_more_batches_than_a_query_reports(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for i in range(6):
            put(tmp_path / "in", f"{i}.txt", b"one\n")
        query = capture(spark, str(tmp_path / "in"), str(tmp_path / "out"), buffer_size=1)
        query.awaitTermination()
        assert captured_totals(query)["records"]["rows"] == 6
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_intake_bounded_by_bytes(spark, tmp_path):
    for i in range(6):
        put(tmp_path / "in", f"{i}.txt", b"x" * 99 + b"\n")
    query = (
        stream_lines(spark, str(tmp_path / "in"), max_bytes=200)
        .writeStream.format("text").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(sizes) == 6 and max(sizes) <= 2
    assert len(values(read_lines(spark, str(tmp_path / "out")))) == 6


class SharedSession:
    """The part of a session that `scratch_dir` reads, with a shared folder set."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder}


def test_scratch_folder_is_the_one_the_session_names(spark, tmp_path):
    shared = SharedSession(f"{tmp_path}/shared/")
    first, second = scratch_dir(shared, "x"), scratch_dir(shared, "x")
    assert first.startswith(f"{tmp_path}/shared/logloom-x-") and first != second
    assert scratch_dir(spark, "y") != scratch_dir(spark, "y")


def test_places_of_lines_in_files_read_in_parts(spark, tmp_path):
    """Files cut into many parts, of lines longer and shorter than a part, against a walk."""
    rng = random.Random(4)
    want = {}
    for name, n in (("a.txt", 3), ("b.txt", 2000), ("c.txt", 1500), ("empty.txt", 0)):
        lines = ["é" * rng.randrange(60) + f"\r{k}" for k in range(n)]
        if n == 1500:
            lines[700] = "long" * 3000
        put(tmp_path / "in", name, "\n".join(lines).encode() + b"\n" * (n > 2 and n != 3))
        want[name] = lines
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4096")
    try:
        frame = read_lines(spark, str(tmp_path / "in"), with_places=True)
        rows = frame.filter(F.length("value") >= 0).collect()
        assert frame.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(size, before)
    for name, lines in want.items():
        found = sorted((r["line_no"], r["value"]) for r in rows if r["path"].endswith(name))
        assert found == list(enumerate(lines))


def test_places_go_on_over_the_files_of_a_folder(spark, tmp_path):
    for folder in ("one", "two"):
        for k in range(12):
            put(tmp_path / folder, f"part-{k:05d}.txt", "".join(f"{folder}-{k}-{i}\n" for i in range(k % 4)).encode())
    frame = read_lines(
        spark, [f"{tmp_path}/one", f"{tmp_path}/two"], with_places=True, per_folder=True
    )
    for folder in ("one", "two"):
        found = sorted((r["line_no"], r["value"]) for r in frame.collect() if f"/{folder}/" in r["path"])
        want = [f"{folder}-{k}-{i}" for k in range(12) for i in range(k % 4)]
        assert found == list(enumerate(want))


def test_files_in_order_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "base")
    monkeypatch.setattr(catalog, "scratch_dir", lambda *_: base)
    texts = [(k, "en" if k % 10 else "de", f"text {k}") for k in range(1000)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(5).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = catalog.q_read_places(spark, str(tmp_path)).collect()
    # Most texts have one language, and no file has many of them.
    counts = spark.read.text(f"{base}/in", lineSep=catalog.RECORD).groupBy("_metadata.file_path").count()
    assert max(row["count"] for row in counts.collect()) < 400
    for lang in ("en", "de"):
        want = [t for _, l, t in texts if l == lang]
        assert sorted((r["line_no"], r["text"]) for r in rows if r["lang"] == lang) == list(enumerate(want))


def test_files_are_capped_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    texts = ["x" * rng.randrange(1, 90) + f"é{k}" for k in range(800)]
    texts[100] = "long" * 200
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "n bigint, json string").repartition(3)
    cap, out = 500, tmp_path / "out"
    write_ndjson(frame, str(out), "n", max_bytes_per_file=cap)
    files = [f.read_bytes() for folder in sorted(out.glob("file=*")) for f in folder.glob("part-*")]
    assert b"".join(files).decode().splitlines() == texts
    assert all(len(f) <= cap or f.count(b"\n") == 1 for f in files)
    # A file is closed only where the next record did not fit; a task ends one early.
    short = [a for a, b in zip(files, files[1:]) if len(a) + len(b.split(b"\n")[0]) + 1 <= cap]
    assert len(short) < 4
    write_ndjson(frame, str(tmp_path / "both"), "n", 3, max_bytes_per_file=cap)
    both = [f.read_bytes() for f in (tmp_path / "both").glob("file=*/part-*")]
    assert all(f.count(b"\n") <= 3 for f in both) and sum(map(len, both)) == sum(map(len, files))
    write_ndjson(frame.limit(0), str(tmp_path / "none"), "n", max_bytes_per_file=cap)
    assert not list((tmp_path / "none").glob("file=*"))


def test_records_are_encoded_after_they_are_in_order(spark, tmp_path):
    frame = spark.createDataFrame([(k, bytearray(b"\xff%d" % k)) for k in range(50)], "n int, raw binary")
    for cap, out in ((None, "plain"), (40, "capped")):
        write_ndjson(
            frame.repartition(4), str(tmp_path / out), "n", max_bytes_per_file=cap,
            encode=lambda rows: rows.select(F.col("raw").cast("string").alias("json")),
        )
        files = sorted((tmp_path / out).glob("**/part-*"))
        assert b"".join(f.read_bytes() for f in files) == b"".join(b"\xff%d\n" % k for k in range(50))


def test_ledger_survives_restarts_and_repeated_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, data in (("1.txt", b"one\ntwo\n"), ("2.txt", b"three\n" + b"x" * 1030)):
        put(tmp_path / "in", name, data)
        query = capture(spark, source, out, max_len=1024, ledger=True)
        query.awaitTermination()
    # The counts of this process are those of the last run; the ledger has all.
    assert captured_totals(query)["lines"] == {"rows": 2, "bytes": 1035}
    wanted = {"lines": (4, 1041), "pieces": (5, 1041), "records": (5, 1041 + 5 * 10)}
    rows = captured_ledger(spark, out).collect()
    assert {r["name"]: (r["rows"], r["bytes"]) for r in rows} == wanted
    # Take the commit of the last batch away: it runs again and overwrites itself.
    commits = tmp_path / "out" / "_checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        if (commits / name).exists():
            (commits / name).rename(tmp_path / f"taken{name}")
    capture(spark, source, out, max_len=1024, ledger=True).awaitTermination()
    rows = captured_ledger(spark, out).collect()
    assert {r["name"]: (r["rows"], r["bytes"]) for r in rows} == wanted
    assert captured_ledger(spark, out, per_batch=True).select("batch").distinct().count() == 2
    records = read_lines(spark, out).count()
    assert records == 5


def test_end_marker_without_a_number_is_an_error(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", None, None)]
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{tmp_path}/chunks")
    arriving = spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/chunks")
    with pytest.raises(Exception, match="seq must not be NULL"):
        reassemble_stream(arriving, f"{tmp_path}/lines", f"{tmp_path}/cp").awaitTermination()


def test_field_sets_of_sources_change_later_records_only(spark, tmp_path):
    def sets(*rows):
        frame = spark.createDataFrame([(s, k, kv) for s, pairs in rows for k, kv in enumerate(pairs)],
                                      "source string, pos bigint, kv string")
        frame.write.mode("overwrite").parquet(str(tmp_path / "sets"))

    def run(**options):
        capture(
            spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), max_len=1024,
            source_sets=str(tmp_path / "sets"), **options,
        ).awaitTermination()
        return values(read_lines(spark, str(tmp_path / "out")))

    put(tmp_path / "in" / "a b", "1.txt", b"one\n")
    put(tmp_path / "in" / "c+d", "1.txt", b"two\n")
    put(tmp_path / "in" / "none", "1.txt", b"three\n")
    sets(("a b", ["x=1"]), ("c+d", ["y=v", "x=2"]))
    first = ['{"msg":"three"}', '{"x":1,"msg":"one"}', '{"y":"v","x":2,"msg":"two"}']
    assert run() == first
    sets(("a b", ["x=5"]), ("c+d", ["="]))
    put(tmp_path / "in" / "a b", "2.txt", b"four\n")
    put(tmp_path / "in" / "c+d", "2.txt", b"five\n")
    second = sorted([*first, '{"x":5,"msg":"four"}', '{"msg":"five"}'])
    assert run() == second
    # The second batch runs again, with the sets that it had then.
    commits = tmp_path / "out" / "_checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        if (commits / name).exists():
            (commits / name).rename(tmp_path / f"taken{name}")
    sets(("a b", ["x=9"]))
    assert run() == second
    errors = {(r["batch"], r["source"]): r["error"] for r in captured_field_sets(spark, str(tmp_path / "out")).collect()}
    assert errors == {(0, "a b"): None, (0, "c+d"): None, (1, "a b"): None, (1, "c+d"): "EINV_FIELD_KEY"}
    with pytest.raises(ValueError):
        run(fields=["a=1"])


def test_shedding_keeps_the_fields_of_sources(spark, tmp_path):
    put(tmp_path / "in" / "s1", "1.txt", b"one\ntwo\nthree\n")
    spark.createDataFrame([("s1", 0, "k=1")], "source string, pos bigint, kv string").write.parquet(str(tmp_path / "sets"))
    capture(
        spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), max_len=1024, policy="drop", capacity=2,
        width="3650 days", source_sets=str(tmp_path / "sets"),
    ).awaitTermination()
    assert values(read_lines(spark, str(tmp_path / "out"))) == ['{"k":1,"msg":"one"}', '{"k":1,"msg":"two"}']
