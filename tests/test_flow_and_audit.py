"""Shedding, custom encoders, audits and profiles on tables."""

import re

import pytest
from pyspark.sql import functions as F

from logloom import (
    Encoder,
    FieldSet,
    cap_lines,
    capture_audit,
    capture_frame,
    csv_encoder,
    encode_ndjson,
    encode_with,
    escape_profile,
    render_prefix,
    shed,
    shed_report,
    split_lines,
    truncate_encoded,
    validate_field_sets,
)


@pytest.mark.parametrize("arrivals, capacity", [(4, 2), (16, 4), (3, 8)])
def test_first_arrivals_are_kept(spark, arrivals, capacity):
    frame = spark.range(arrivals).select(F.lit("b").alias("bucket"), F.col("id").alias("ord"))
    kept = sorted(r.ord for r in shed(frame, "bucket", "ord", capacity).collect())
    assert kept == list(range(min(arrivals, capacity)))
    report = shed_report(frame, "bucket", capacity).first()
    assert (report.arrived, report.kept, report.dropped) == (
        arrivals, min(arrivals, capacity), max(arrivals - capacity, 0),
    )


@pytest.mark.parametrize("capacity", [3, 1200])
def test_shedding_of_a_hot_bucket_is_exact(spark, capacity):
    frame = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("bucket"),
        (9000 - F.col("id")).alias("ord"),
    )
    by_bucket = {}
    for row in frame.collect():
        by_bucket.setdefault(row.bucket, []).append(row.ord)
    got = {}
    for row in shed(frame, "bucket", "ord", capacity).collect():
        got.setdefault(row.bucket, []).append(row.ord)
    assert {k: sorted(v) for k, v in got.items()} == {
        k: sorted(v)[:capacity] for k, v in by_bucket.items()
    }


def test_one_plan_for_every_capacity_ranks_no_bucket(spark):
    frame = spark.range(300_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise("b").alias("bucket"), F.xxhash64("id").alias("ord"), "id"
    )
    plans = []
    for capacity in (8, 100_000):
        kept = shed(frame, "bucket", "ord", capacity)
        plans.append(re.sub(r"\d+", "", kept._jdf.queryExecution().optimizedPlan().toString()))
        counts = {r.bucket: r for r in kept.groupBy("bucket").agg(F.count("*").alias("n"), F.max("ord").alias("last")).collect()}
        for name, total in (("hot", 240_000), ("b", 60_000)):
            want = min(capacity, total)
            assert counts[name].n == want
            below = frame.filter((F.col("bucket") == name) & (F.col("ord") <= counts[name].last)).count()
            assert below == want
    assert plans[0] == plans[1] and "Window" not in plans[0]
    with pytest.raises(ValueError):
        shed(frame, "bucket", "ord", 0)


def test_shedding_keeps_null_buckets_and_orders(spark):
    rows = [(None, 2), (None, 1), (None, None), ("a", 5), ("a", 4)]
    frame = spark.createDataFrame(rows, "bucket string, ord bigint")
    got = {tuple(r) for r in shed(frame, "bucket", "ord", 2).collect()}
    assert got == {(None, None), (None, 1), ("a", 4), ("a", 5)}
    assert shed(frame.limit(0), "bucket", "ord", 2).count() == 0


def test_identity_encoder_counts_bytes(spark):
    encoder = Encoder(lambda fields: "x", lambda msg: msg, lambda fields: "x")
    lines = spark.createDataFrame([("datada",), ("ta",), ("data",)], "line string")
    records = [r.record for r in encode_with(lines, "line", encoder).collect()]
    assert records == ["xdatadax", "xtax", "xdatax"]
    assert sum(map(len, records)) == 18


def test_csv_encoder(spark):
    rows = spark.createDataFrame([('say "hi"',)], "m string")
    got = encode_with(rows, "m", csv_encoder(), ['a=1,"2"', "b=x"]).first().record
    assert got == '"1,""2""","x","say ""hi"""'


def test_audit_balances_and_finds_losses(spark, documents):
    keys = ["doc_id", "source"]
    raw = split_lines(documents, keys, "text")
    records = capture_frame(documents, keys, "text", ["a=1"], 1024)
    audit = capture_audit(raw, records, "source").collect()
    assert audit and all(row.balanced for row in audit)
    assert sum(r.lines for r in audit) == raw.count()
    assert sum(r.pieces for r in audit) == records.count()

    victim = records.orderBy("doc_id", "line_no").first()
    lost = records.filter(~((F.col("doc_id") == victim.doc_id) & (F.col("line_no") == victim.line_no)))
    wrong = [r.source for r in capture_audit(raw, lost, "source").collect() if not r.balanced]
    assert wrong == [victim.source]
    invented = raw.filter(F.col("source") != victim.source)
    wrong = [r for r in capture_audit(invented, records, "source").collect() if not r.balanced]
    assert [(r.source, r.lines, r.growth) for r in wrong] == [(victim.source, 0, None)]


def test_fields_follow_the_key_of_the_message(spark):
    rows = spark.createDataFrame([("hi",)], "m string")
    assert encode_ndjson(rows, "m", ["msg=1"], msg_key="line").first().json == '{"msg":1,"line":"hi"}'
    for wrong in (lambda: encode_ndjson(rows, "m", ["line=1"], msg_key="line"),
                  lambda: encode_ndjson(rows, "m", FieldSet((("line", "1"),)), msg_key="line"),
                  lambda: encode_ndjson(rows, "m", [], msg_key='a"b'),
                  lambda: render_prefix("m", msg_key="")):
        with pytest.raises(ValueError):
            wrong()
    kv = spark.createDataFrame([(1, 0, "line=1"), (1, 1, "msg=2")], "s int, pos bigint, kv string")
    assert validate_field_sets(kv, "s", "pos", msg_key="line").first().error_pos == 0
    assert validate_field_sets(kv, "s", "pos").first().error_pos == 1


def test_truncation_keeps_bytes_that_are_not_utf8(spark):
    data = bytearray(b'a\xff"\xfe\xffbc')
    frame = spark.createDataFrame([(data,)], "d binary").select(F.col("d").cast("string").alias("m"))
    for unit in ("char", "byte"):
        for budget, want in ((2, b"a\xff"), (3, b"a\xff"), (4, b'a\xff\\"'), (99, b'a\xff\\"\xfe\xffbc')):
            got = truncate_encoded(frame, "m", budget, unit).select(F.col("encoded").cast("binary")).first()[0]
            assert bytes(got) == want, (unit, budget)


def test_escape_profile_classes(spark):
    rows = spark.createDataFrame(
        [("a" * 64,), ("é" * 128,), ("a" * 129,), ("a" * 513,), ("ab\tcdefghi",), ("\x07\x07ab",), ("",)],
        "m string",
    )
    got = {(r.size_class, r.escape_class): r for r in escape_profile(rows, "m").collect()}
    assert {k: r.n_rows for k, r in got.items()} == {
        ("short", "plain"): 3, ("medium", "plain"): 1, ("long", "plain"): 1,
        ("short", "escaped"): 1, ("short", "highly_escaped"): 1,
    }
    worst = got["short", "highly_escaped"]
    assert (worst.bytes_raw, worst.bytes_encoded, worst.growth) == (4, 14, 3.5)


@pytest.mark.parametrize("capacity", [1, 3, 7, 10, 11])
def test_equal_orders_are_cut_exactly(spark, capacity):
    """Ties at the cut, a bucket of equal rows, and columns that have no hash."""
    rows = [("ties", 5, f"row {k}") for k in range(10)]
    rows += [("equal", 1, "same")] * 10
    rows += [("late ties", k if k < 2 else 9, f"{k}") for k in range(10)]
    rows += [("few", 1, "a"), (None, 1, "x"), (None, 1, "x")]
    frame = spark.createDataFrame(rows, "b string, o int, v string").repartition(5)
    frame = frame.withColumn("m", F.create_map("v", "o"))
    kept = shed(frame, "b", "o", capacity)
    counts = {r["b"]: r["kept"] for r in shed_report(frame, "b", capacity).collect()}
    found = [(r["b"], r["o"], r["v"]) for r in kept.collect()]
    assert {b: sum(r[0] == b for r in found) for b in counts} == counts
    assert kept.columns == frame.columns
    # The first orders are all there, and no row is there more often than it was.
    assert sum(r[0] == "late ties" and r[1] < 2 for r in found) == min(capacity, 2)
    assert all(found.count(r) <= rows.count(r) for r in found)
    again = [(r["b"], r["o"], r["v"]) for r in shed(frame.repartition(3), "b", "o", capacity).collect()]
    assert sorted(found, key=repr) == sorted(again, key=repr)


def test_a_bucket_of_equal_orders_is_spread_over_tasks(spark):
    frame = spark.range(6000).select(F.lit("hot").alias("b"), F.lit(0).alias("o"), "id")
    # So small a table would be merged into one task.
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        kept = shed(frame, "b", "o", 4001)
    finally:
        spark.conf.set(merge, "true")
    assert kept.select("id").distinct().count() == kept.count() == 4001
    quota = spark.read.parquet(*[f for f in kept.inputFiles() if "shed-quota" in f])
    shares = [r["count"] for r in quota.groupBy("_part").count().collect()]
    assert len(shares) == 4 and max(shares) < 6000 / 2


def test_audit_reads_bytes_that_are_not_utf8(spark):
    lines = spark.createDataFrame([("g", 0, bytearray(b'c\xffd"\x01\n')), ("g", 1, bytearray("é🧪".encode()))],
                                  "src string, line_no bigint, raw binary")
    lines = lines.select("src", "line_no", F.col("raw").cast("string").alias("line"))
    records = encode_ndjson(lines.withColumn("piece_no", F.lit(0)), "line", ["a=msg"])
    row = capture_audit(lines, records, "src", line_key="line_no").first()
    assert row["balanced"] and row["digest_in"] == row["digest_out"] and row["bytes_in"] == 6 + 6


def test_audit_finds_swapped_messages(spark):
    texts = ["one line", "two line", "x" * 25]
    lines = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "src string, n bigint, line string")
    swapped = lines.withColumn("line", F.when(F.col("n") == 0, "two line").when(F.col("n") == 1, "one line").otherwise(F.col("line")))

    def audit(source, **options):
        records = encode_ndjson(cap_lines(source, 10), "line")
        return capture_audit(lines, records, "src", **options).first()["balanced"]

    assert audit(lines) and audit(swapped)
    assert audit(lines, line_key="n", max_len=10)
    assert not audit(swapped, line_key="n", max_len=10)
    # Without the numbers of the lines the same messages are there.
    assert audit(swapped, line_key=(), max_len=10)
    assert not audit(lines.filter("n < 2"), line_key="n", max_len=10)
