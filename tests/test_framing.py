"""Lines, chunks, capping and re-assembly."""

import random

import pytest
from pyspark.sql import functions as F

from logloom import cap_lines, chunk_text, reassemble_lines, split_lines
from logloom.operators.framing import _border_pieces, chunk_origins, chunk_rows


def lines_of(text):
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def cut(line, size):
    return [line[i : i + size] for i in range(0, len(line), size)] or [""]


TEXTS = [
    "", "\n", "\n\n", "a", "a\n", "a\nb", "a\n\nb\n", "\na", "a\r\nb\r", "é\n🧪🧪\n",
    "x" * 40, "x" * 16 + "\n" + "y" * 32 + "\n", "x" * 16, "\n" * 20, "ab\n" * 30 + "tail",
]


def texts_frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def by_id(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row[0], []).append(tuple(row[1:]))
    return {key: sorted(rows) for key, rows in out.items()}


def test_split_lines(spark):
    got = by_id(split_lines(texts_frame(spark), "id", "text"))
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == list(enumerate(lines_of(text)))


def test_split_lines_of_null_is_nothing(spark):
    frame = spark.createDataFrame([(1, None)], "id bigint, text string")
    assert split_lines(frame, "id", "text").count() == 0


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_chunk_text(spark, size):
    got = by_id(chunk_text(texts_frame(spark), "id", "text", size))
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == list(enumerate(cut(text, size) if text else []))


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_chunk_text_by_bytes(spark, size):
    got = by_id(chunk_text(texts_frame(spark), "id", "text", size, "byte"))
    for i, text in enumerate(TEXTS):
        blocks = [bytes(b) for _, b in got.get(i, [])]
        assert b"".join(blocks) == text.encode()
        assert all(len(b) == size for b in blocks[:-1])


@pytest.mark.parametrize("size", [1, 4, 16])
def test_cap_lines(spark, size):
    lines = split_lines(texts_frame(spark), "id", "text")
    got = by_id(cap_lines(lines, size).select("id", "line_no", "piece_no", "line"))
    for i, text in enumerate(TEXTS):
        want = [(n, k, p) for n, line in enumerate(lines_of(text)) for k, p in enumerate(cut(line, size))]
        assert got.get(i, []) == want


@pytest.mark.parametrize("size", [4, 5, 7])
def test_cap_lines_by_bytes_keeps_characters_whole(spark, size):
    texts = ["aé🧪" * 9, "🧪" * 10, "é" * 11, "abcd", "abcde", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, line string")
    got = by_id(cap_lines(frame, size, "byte").select("id", "piece_no", "line"))
    for i, text in enumerate(texts):
        data, borders = text.encode(), [0]
        for k in range(1, -(-len(data) // size)):
            position = k * size
            while 0x80 <= data[position] <= 0xBF:
                position -= 1
            borders.append(position)
        borders.append(len(data))
        want = [data[a:b].decode() for a, b in zip(borders, borders[1:])]
        assert [piece for _, piece in got[i]] == want


def test_sizes_are_checked(spark):
    frame = texts_frame(spark)
    for call in (
        lambda: chunk_text(frame, "id", "text", 0),
        lambda: chunk_text(frame, "id", "text", 5, "word"),
        lambda: cap_lines(frame, 3, "byte", "text"),
        lambda: reassemble_lines(frame, "id", "id", "text", max_len=0),
        lambda: reassemble_lines(frame.withColumnRenamed("id", "line"), "line", "line", "text"),
    ):
        with pytest.raises(ValueError):
            call()


STREAMS = {
    "one": ["data\n"],
    "over chunks": ["data", "da\nta", "\ndata\n"],
    "none": ["abc", "def"],
    "tail": ["a\nb", "c"],
    "border": ["abcd", "\nefgh\n", "\n"],
    "empty chunks": ["", "a", "", "\n", ""],
    "crlf": ["a\r", "\nb\r\n"],
    "only feeds": ["\n\n\n", "\n"],
    "many": ["data\n"] * 100,
    "exact": ["x" * 8, "\n", "y" * 4, "y" * 4, "\nz"],
    "exact open": ["x" * 8],
}


@pytest.mark.parametrize("span", [1, 2, 65536])
@pytest.mark.parametrize("max_len", [None, 1, 4, 8])
def test_reassemble_streams(spark, span, max_len):
    rows = [(s, i, d) for s, parts in STREAMS.items() for i, d in enumerate(parts)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "stream_id string, seq bigint, data string")
    got = by_id(reassemble_lines(frame, max_len=max_len, span=span))
    for name, parts in STREAMS.items():
        lines = lines_of("".join(parts))
        if max_len is None:
            want = list(enumerate(lines))
        else:
            want = [(n, k, p) for n, line in enumerate(lines) for k, p in enumerate(cut(line, max_len))]
        assert got.get(name, []) == want, name


@pytest.mark.parametrize("unit", ["char", "byte"])
@pytest.mark.parametrize("size", [1, 37, 1024, 10**6])
def test_reassembly_undoes_chunking(spark, documents, unit, size):
    some = documents if size > 1 else documents.filter(F.length("text") < 200)
    want = split_lines(some, "doc_id", "text")
    got = reassemble_lines(chunk_text(some, "doc_id", "text", size, unit), "doc_id", max_len=None)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_pieces_of_binary_chunks_are_cut_by_bytes(spark):
    frame = spark.createDataFrame([(1, 0, bytearray("aé🧪\nb".encode()))], "s int, seq bigint, data binary")
    got = reassemble_lines(frame, "s", max_len=4).orderBy("line_no", "piece_no").collect()
    assert [bytes(r.line) for r in got] == ["aé🧪".encode()[:4], "aé🧪".encode()[4:], b"b"]


def test_sequence_numbers_beyond_doubles(spark):
    base = 2**53 + 1
    frame = spark.createDataFrame([("s", base, "a"), ("s", base + 1, "b\nc"), ("s", base + 2, "\n")],
                                  "stream_id string, seq bigint, data string")
    got = reassemble_lines(frame, span=1, max_len=None)
    assert by_id(got) == {"s": [(0, "ab"), (1, "c")]}


def test_one_stream_that_is_the_whole_table(spark):
    n = 3000
    frame = spark.range(n).select(
        F.lit("hot").alias("stream_id"), F.col("id").alias("seq"),
        F.concat(F.lit("stream data\n").substr(1, 12), F.col("id").cast("string")).alias("data"),
    )
    text = "".join(f"stream data\n{i}" for i in range(n))
    got = by_id(reassemble_lines(frame, span=100, max_len=None))
    assert got == {"hot": list(enumerate(lines_of(text)))}


@pytest.mark.parametrize("max_len", [None, 16384])
def test_a_stream_without_any_line_feed(spark, max_len):
    frame = spark.range(500).select(
        F.lit("hot").alias("stream_id"), F.col("id").alias("seq"), F.repeat(F.lit("x"), 100).alias("data")
    )
    got = reassemble_lines(frame, max_len=max_len).collect()
    assert sum(len(r.line) for r in got) == 50000
    assert len(got) == (1 if max_len is None else 4)


def test_texts_stay_out_of_the_windows(spark, documents):
    chunks = chunk_text(documents, "doc_id", "text", 64)
    plan = reassemble_lines(chunks, "doc_id")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "+- Window [" in line or ":- Window [" in line]
    assert windows and all("data#" not in line for line in windows)


def test_split_reads_only_the_columns_it_needs(spark, documents):
    plan = split_lines(documents, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in plan


BYTES = [b"c\xffd\nab\xfe\xffcd\n", b"\xff" * 10, b"x\xc3\ny", b"\xe2\x82\n", "é🧪".encode() * 4, b"\x9f\xaa" * 9]


def bytes_frame(spark, data=BYTES):
    rows = [(i, bytearray(d)) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, data binary").select(
        "id", F.col("data").cast("string").alias("text")
    )


def raw(frame, column):
    return by_id(frame.withColumn(column, F.col(column).cast("binary")))


def test_split_keeps_bytes_that_are_not_utf8(spark):
    got = raw(split_lines(bytes_frame(spark), "id", "text"), "line")
    for i, data in enumerate(BYTES):
        parts = data.split(b"\n")
        parts = parts[:-1] if parts[-1] == b"" else parts
        assert [bytes(line) for _, line in got[i]] == parts


@pytest.mark.parametrize("unit", ["char", "byte"])
@pytest.mark.parametrize("size", [4, 7, 100])
def test_cutting_keeps_bytes_that_are_not_utf8(spark, unit, size):
    chunks = chunk_text(bytes_frame(spark), "id", "text", size, unit)
    got = raw(chunks, "data")
    assert [b"".join(bytes(d) for _, d in got[i]) for i in range(len(BYTES))] == BYTES
    lines = bytes_frame(spark).withColumnRenamed("text", "line")
    got = raw(cap_lines(lines, size, unit).select("id", "piece_no", "line"), "line")
    assert [b"".join(bytes(d) for _, d in got[i]) for i in range(len(BYTES))] == BYTES
    # Every byte of such a text counts as a character.
    if unit == "char":
        assert [len(bytes(d)) for _, d in got[1]] == [len(p) for p in cut("x" * 10, size)]


def test_streams_without_an_id(spark):
    rows = [(None, 0, "a\nb"), (None, 1, "c\n"), ("s", 0, "x"), ("s", 1, "y\nz")]
    frame = spark.createDataFrame(rows, "stream_id string, seq bigint, data string")
    assert by_id(reassemble_lines(frame, max_len=None, span=1)) == {
        None: [(0, "a"), (1, "bc")], "s": [(0, "xy"), (1, "z")],
    }


@pytest.mark.parametrize("rows", [[("s", None, "a\n"), ("s", 1, "b\n")], [("s", 0, "p"), ("s", 0, "q\n")]])
def test_missing_and_repeated_numbers_are_errors(spark, rows):
    frame = spark.createDataFrame(rows, "stream_id string, seq bigint, data string")
    with pytest.raises(Exception, match="seq (must not be NULL|occurs twice)"):
        reassemble_lines(frame).collect()


def test_texts_are_shuffled_once(spark, documents):
    """With broadcasting off, one exchange carries the texts, and both branches read it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = reassemble_lines(chunk_text(documents, "doc_id", "text", 64), "doc_id")
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan") <= 2


def test_only_the_ends_of_a_chunk_are_grouped(spark):
    """Of a long line too: the pieces that lie inside a chunk are not shuffled."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcñ") for _ in range(1000)) for _ in range(3)]
    parts[1] = parts[1][:500] + "\n" + parts[1][501:]
    frame = spark.createDataFrame(
        [("s", k, p) for k, p in enumerate(parts)], "stream_id string, seq bigint, data string"
    )
    chunks, _, _ = chunk_rows(frame, "stream_id", "seq", "data")
    placed = chunks.join(chunk_origins(chunks, True, 1), ["ids", "seq"])
    grouped = placed.select(_border_pieces(16).alias("pieces")).collect()
    assert all(len(r["pieces"]) <= 2 and all(len(p["part"]) <= 16 for p in r["pieces"]) for r in grouped)
    want = [(i, k, p) for i, line in enumerate(lines_of("".join(parts))) for k, p in enumerate(cut(line, 16))]
    assert by_id(reassemble_lines(frame, max_len=16)) == {"s": want}


def test_ends_meet_counters_only(spark):
    """An end cuts a stream into parts, each with lines from 0; texts need not meet the ends."""
    rows = [("s", 0, "a\nb"), ("s", 1, "c"), ("s", 3, "d\n"), ("s", 4, "e")]
    frame = spark.createDataFrame(rows, "stream_id string, seq bigint, data string")
    chunks, _, _ = chunk_rows(frame, "stream_id", "seq", "data")
    ends = chunks.groupBy("ids").agg(F.array(F.lit(2).cast("bigint")).alias("ends"))
    got = chunk_origins(chunks, True, 1, ends).select("seq", "ids.part", "first_line", "offset")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 0), (1, 0, 1, 1), (3, 1, 0, 0), (4, 1, 1, 0)]


def test_byte_offsets_of_one_hot_stream_are_spread_over_tasks(spark):
    """Numbers as far apart as offsets of chunks of any size; every range has its share of rows."""
    n = 4000
    rows = [("cold", 0, "a\nb")]
    rng, at, text = random.Random(6), 0, ""
    for k in range(n):
        part = "x" * rng.randrange(30) + ("\n" if rng.random() < 0.3 else "")
        rows.append(("hot", at, part))
        at, text = at + rng.choice([1, 70000, 10**9]), text + part
    frame = spark.createDataFrame(rows, "stream_id string, seq bigint, data string").repartition(5)
    chunks, _, _ = chunk_rows(frame, "stream_id", "seq", "data")
    origins = chunk_origins(chunks, True, 1)
    scan = [p for p in origins.inputFiles() if "chunk-ranges" in p]
    shares = spark.read.parquet(*scan).groupBy("part").count().collect()
    assert len(shares) == 4
    assert max(row["count"] for row in shares) < 2 * (n + 1) / 4
    got = by_id(reassemble_lines(frame, max_len=16, span=1))
    want = [(i, k, p) for i, line in enumerate(lines_of(text)) for k, p in enumerate(cut(line, 16))]
    assert got == {"hot": want, "cold": [(0, 0, "a"), (1, 0, "b")]}


def test_cutting_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(7, 8, "añb" * 3)], "_bytes int, __bytes int, line string")
    got = cap_lines(rows, 5, "byte").collect()
    assert [(r["_bytes"], r["__bytes"]) for r in got] == [(7, 8)] * len(got)
    assert "".join(r["line"] for r in got) == "añb" * 3
    blocks = chunk_text(rows, "_bytes", "line", 5, "byte").collect()
    assert {r["_bytes"] for r in blocks} == {7} and b"".join(bytes(r["data"]) for r in blocks) == "añb".encode() * 3
