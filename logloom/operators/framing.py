"""Lines and chunks: splitting texts, capping long lines, re-assembling chunked streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cuts import (
    byte_blocks,
    byte_pieces,
    char_pieces,
    int_div,
    pieces_bytewise,
    text_length,
)
from ..limits import (
    DEFAULT_CHUNK,
    UNITS,
    check_choice,
    check_free,
    check_range,
    check_unit,
    names,
    unused,
)
from ..session import settled

LF = "\n"

# Chunks per range of the running totals in `chunk_origins`, where partitions allow it.
BLOCK_SPAN = 65536


def split_lines(df: DataFrame, id_cols: str | Sequence[str], text_col: str) -> DataFrame:
    """One row per line: the id columns, `line_no` from 0, and `line`.

    Only LF separates lines. Empty lines are kept. Text after the last LF is a
    line unless it is empty, so an empty or NULL text gives no line. Every byte is
    kept, also of texts that are not UTF-8. No shuffle.
    """
    text = F.col(text_col)

    def parts(whole: Column) -> Column:
        body = F.when(
            F.endswith(whole, F.lit(LF)), F.left(whole, F.char_length(whole) - F.lit(1))
        ).otherwise(whole)
        return F.split(body, LF, -1)

    return df.filter(text != "").select(
        *names(id_cols), F.posexplode(pieces_bytewise(text, parts)).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def chunk_text(
    df: DataFrame, id_cols: str | Sequence[str], text_col: str, size: int, unit: str = "char"
) -> DataFrame:
    """One row per block of `size` units: the id columns, `seq` from 0, and `data`.

    The last block may be shorter. Blocks of characters are strings. Blocks of
    bytes are binary, because a block border may fall inside a character.
    """
    check_range("size", size, 1)
    check_choice("unit", unit, UNITS)
    ids, text = names(id_cols), F.col(text_col)
    if unit == "byte":
        # In a step of its own, so that it happens once per text.
        whole = unused(ids, "_bytes")
        df = df.select(*ids, text.cast("binary").alias(whole))
        blocks = byte_blocks(F.col(whole), size)
    else:
        blocks = char_pieces(text, size)
    return df.select(*ids, F.posexplode(blocks).alias("seq", "data")).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


def cap_lines(
    lines: DataFrame, max_len: int, unit: str = "char", line_col: str = "line"
) -> DataFrame:
    """Split lines longer than `max_len` into consecutive pieces, numbered by `piece_no`.

    All other columns are kept. A line that fits, and an empty line, is one
    piece. A line of exactly k * max_len units is k pieces.
    """
    check_unit(unit, max_len)
    others = [name for name in lines.columns if name != line_col]
    line = F.col(line_col)
    if unit == "char":
        fits, cut = text_length(line) <= max_len, char_pieces(line, max_len)
    else:
        # In a step of its own, so that it happens once per line.
        whole = unused(lines.columns, "_bytes")
        lines = lines.withColumn(whole, line.cast("binary"))
        fits, cut = F.octet_length(line) <= max_len, byte_pieces(F.col(whole), max_len)
    pieces = F.when(fits, F.array(line)).otherwise(cut)
    return lines.select(*others, F.posexplode(pieces).alias("piece_no", line_col)).withColumn(
        "piece_no", F.col("piece_no").cast("bigint")
    )


def _line_feeds(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(LF), F.lit("")))).cast(
        "bigint"
    )


def chunk_origins(
    chunks: DataFrame, with_offsets: bool, span: int, ends: DataFrame | None = None
) -> DataFrame:
    """For every chunk, where it starts: `first_line`, and `offset` inside that line.

    Takes `ids`, `seq`, `text`, and `skip_lines` / `skip_chars`, which count as
    content ahead of the chunk. `ends` (`ids`, and the numbers `ends` in order) cut streams
    into parts: `ids` of the result are then the `ids`, the `part` and how many `parts` have
    an end, and every part is a stream. These are running totals over a stream, and a
    stream may be most of the table, so the counters are sorted by stream and `seq`
    into ranges of about as many rows each, whatever the numbers are. Every range is summed up
    per stream (line feeds, characters, where its last line starts), and the sums of
    earlier ranges, which add up in order, are what a range starts with. Only
    counters take part; the texts stay behind. A `seq` that occurs twice in a stream is an
    error. No range is meant to have more than `span` rows, but there are no more of
    them than shuffle partitions.
    """
    text, after_lf = F.col("text"), F.substring_index("text", LF, -1)
    chars = F.char_length(text).cast("bigint") if with_offsets else F.lit(0).cast("bigint")
    seen = Observation()
    counters = chunks.select(
        "ids",
        "seq",
        _line_feeds(text).alias("line_feeds"),
        chars.alias("chars"),
        (F.char_length(after_lf).cast("bigint") if with_offsets else chars).alias("tail_chars"),
        "skip_lines",
        "skip_chars",
    )
    if ends is not None:
        part = F.size(F.filter("ends", lambda end: end < F.col("seq")))
        counters = (
            counters.join(ends, "ids", "left")
            .withColumn("ends", F.coalesce("ends", F.array().cast("array<bigint>")))
            .withColumn(
                "ids", F.struct("ids", part.alias("part"), F.size("ends").alias("parts"))
            )
            .drop("ends")
        )
    # Written once: the ranges are found by a first look, and made from the same rows.
    counters = settled(
        counters.observe(seen, F.count(F.lit(1)).alias("n")), "chunk-counters"
    )
    most = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(most, -(-seen.get["n"] // span)))
    ranged = settled(
        counters.repartitionByRange(ranges, "ids", "seq").withColumn("part", F.spark_partition_id()),
        "chunk-ranges",
    )
    # Neither is ever NULL; said here, both readers of the shuffle below have the same plan.
    ranged = ranged.filter("ids IS NOT NULL AND part IS NOT NULL").repartition("ids", "part")

    in_range = Window.partitionBy("ids", "part").orderBy("seq")
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_range.rowsBetween(Window.unboundedPreceding, 0)

    def total(amount: Column, skip: str) -> Column:
        return F.coalesce(F.sum(amount).over(before), F.lit(0)) + F.sum(skip).over(upto)

    twice = F.raise_error(F.lit("a seq occurs twice in a stream")).cast("bigint")
    local = ranged.withColumns(
        {
            "lines_before": F.when(F.lag("seq").over(in_range) == F.col("seq"), twice).otherwise(
                total(F.col("line_feeds"), "skip_lines")
            ),
            "chars_before": total(F.col("chars"), "skip_chars"),
        }
    ).withColumn(
        # Where the line that is open after this chunk starts, inside the range.
        "open_start",
        F.when(
            F.col("line_feeds") > 0,
            F.col("chars_before") + F.col("chars") - F.col("tail_chars"),
        ),
    )
    parts = local.groupBy("ids", "part").agg(
        F.sum(F.col("line_feeds") + F.col("skip_lines")).alias("part_lines"),
        F.sum(F.col("chars") + F.col("skip_chars")).alias("part_chars"),
        F.max("open_start").alias("part_open"),
    )
    # A stream has at most one row here per range, and all rows but two of a range are
    # those of streams that it holds whole.
    over_parts = (
        Window.partitionBy("ids").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        parts.withColumns(
            {
                "line_base": F.coalesce(F.sum("part_lines").over(over_parts), F.lit(0)),
                "char_base": F.coalesce(F.sum("part_chars").over(over_parts), F.lit(0)),
            }
        )
        .withColumn(
            "open_base",
            F.coalesce(
                F.max(F.col("char_base") + F.col("part_open")).over(over_parts), F.lit(0)
            ),
        )
        .select("ids", "part", "line_base", "char_base", "open_base")
    )
    placed = local.withColumn("open_before", F.max("open_start").over(before)).join(
        parts, ["ids", "part"]
    )
    open_start = F.coalesce(F.col("char_base") + F.col("open_before"), F.col("open_base"))
    return placed.select(
        "ids",
        "seq",
        (F.col("line_base") + F.col("lines_before")).alias("first_line"),
        (F.col("char_base") + F.col("chars_before") - open_start).alias("offset"),
    )


def assemble(
    chunks: DataFrame,
    max_len: int | None,
    span: int = BLOCK_SPAN,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Pieces of lines from `ids`, `seq`, `text`, `skip_lines`, `skip_chars`.

    Returns `ids`, `line_no`, `piece_no`, `line` and `open`. The last piece of every
    stream, which may be empty, is open; all others are complete. Without
    `max_len` every line is one piece. `ends` are those of `chunk_origins`, as are then the
    `ids`; only counters meet them.

    Texts meet their origins in one join, on which both branches below are built,
    so that they are shuffled once. Pieces that lie inside one chunk are complete
    where they are and are not shuffled again. Only the first and the last piece of
    each chunk are grouped by line and piece.
    """
    origins = chunk_origins(chunks, max_len is not None, span, ends)
    own = F.col("ids") if ends is None else F.col("ids.ids")
    placed = chunks.select(F.col("ids").alias("own"), "seq", "text").join(
        origins.withColumn("own", own), ["own", "seq"]
    )
    borders = (
        placed.select("ids", "seq", F.explode(_border_pieces(max_len)).alias("cut"))
        .select("ids", "seq", "cut.*")
        .groupBy("ids", "line_no", "piece_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("parts"),
            F.max("ended").alias("ended"),
        )
        .withColumn("line", F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    )
    full = F.lit(False) if max_len is None else F.char_length("line") >= max_len
    borders = borders.withColumn("open", ~F.col("ended") & ~full).filter(
        # An empty piece after a full one only says that the line ended there.
        ~F.col("ended") | (F.col("piece_no") == 0) | (F.col("line") != "")
    )
    columns = ["ids", "line_no", "piece_no", "line", "open"]
    return (
        _inner_pieces(placed, max_len)
        .withColumn("open", F.lit(False))
        .select(*columns)
        .unionByName(borders.select(*columns))
    )


def _inner_pieces(placed: DataFrame, max_len: int | None) -> DataFrame:
    """The pieces that lie inside one chunk: all but its first and its last, open one."""
    split = F.split("text", LF, -1)
    last = F.size(split) - 1
    parts = placed.select(
        "ids",
        "first_line",
        "offset",
        last.alias("last"),
        F.posexplode(split).alias("i", "part"),
    ).withColumn("line_no", F.col("first_line") + F.col("i"))
    inside = (F.col("i") > 0) & (F.col("i") < F.col("last"))
    part = F.col("part")
    if max_len is None:
        return parts.filter(inside).select(
            "ids", "line_no", F.lit(0).cast("bigint").alias("piece_no"), part.alias("line")
        )
    # Of the first part of a chunk, what follows its first cut; of its last, what its last cut ends.
    head = F.col("i") == 0
    offset = F.when(head, F.col("offset")).otherwise(F.lit(0).cast("bigint"))
    end = offset + F.char_length(part)
    low = F.when(head, int_div(offset, max_len) + 1).otherwise(F.lit(0).cast("bigint"))
    high = F.when(F.col("i") < F.col("last"), int_div(end - 1, max_len)).otherwise(
        int_div(end, max_len) - 1
    )
    parts = parts.select(
        "ids", "line_no", "part", inside.alias("inside"), offset.alias("offset"),
        low.alias("low"), high.alias("high"),
    ).filter("inside OR low <= high")
    cut = F.transform(
        F.sequence("low", F.greatest("low", "high")),
        lambda number: F.substring(
            part, (number * max_len - F.col("offset") + 1).cast("int"), F.lit(max_len)
        ),
    )
    pieces = (
        F.when(~F.col("inside"), cut)
        .when(text_length(part) <= max_len, F.array(part))
        .otherwise(char_pieces(part, max_len))
    )
    return parts.select(
        "ids", "line_no", "low", F.posexplode(pieces).alias("k", "line")
    ).select("ids", "line_no", (F.col("low") + F.col("k")).alias("piece_no"), "line")


def _border_pieces(max_len: int | None) -> Column:
    """Array of what a chunk adds to the piece that it begins in and to the one it ends in.

    Lines are cut where the whole line is cut: every `max_len` from its start. A chunk that
    ends on a cut while the line goes on also opens the next piece.
    """
    text, line_no, offset = F.col("text"), F.col("first_line"), F.col("offset")
    zero = F.lit(0).cast("bigint")
    first, last = F.substring_index(text, LF, 1), F.substring_index(text, LF, -1)
    fed = F.contains(text, F.lit(LF))
    below = line_no + _line_feeds(text)

    def piece(number: Column, piece_no: Column, ended: Column, part: Column) -> Column:
        return F.struct(
            number.alias("line_no"),
            piece_no.alias("piece_no"),
            ended.alias("ended"),
            part.alias("part"),
        )

    if max_len is None:
        begun = piece(line_no, zero, fed, first)
        return F.when(
            fed, F.array(begun, piece(below, zero, F.lit(False), last))
        ).otherwise(F.array(begun))
    at = int_div(offset, max_len)
    room = (at + 1) * max_len - offset
    end = offset + F.char_length(first)
    begun = piece(
        line_no, at, fed & (end <= (at + 1) * max_len), F.substring(first, F.lit(1), room.cast("int"))
    )

    def rest(number: Column, part: Column, begin: Column) -> Column:
        """The open piece that a part, which starts at `begin` of its line, ends in."""
        piece_no = int_div(begin + F.char_length(part), max_len)
        start = (piece_no * max_len - begin + 1).cast("int")
        return piece(
            number, piece_no, F.lit(False), F.substring(part, start, F.lit(max_len))
        )

    return (
        F.when(fed, F.array(begun, rest(below, last, zero)))
        .when(int_div(end, max_len) > at, F.array(begun, rest(line_no, text, offset)))
        .otherwise(F.array(begun))
    )


def chunk_rows(
    chunks: DataFrame, stream: str | Sequence[str], seq: str, data: str
) -> tuple[DataFrame, list[str], bool]:
    """Bring a chunk table to the columns `assemble` reads; tell whether it was binary.

    The ids become one struct, which joins and groups with NULL ids too. Binary
    chunks may break inside a character. They are read as ISO-8859-1, one character
    per byte, which keeps every byte through the string operations.
    """
    streams = names(stream)
    check_free(streams, ("ids", "seq", "text", "line_no", "piece_no", "line", "open"))
    binary = isinstance(chunks.schema[data].dataType, T.BinaryType)
    text = F.decode(F.col(data), "ISO-8859-1") if binary else F.col(data)
    missing = F.raise_error(F.lit("seq must not be NULL")).cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = chunks.filter(F.col(data).isNotNull()).select(
        F.struct(*streams).alias("ids"),
        F.coalesce(F.col(seq).cast("bigint"), missing).alias("seq"),
        text.alias("text"),
        zero.alias("skip_lines"),
        zero.alias("skip_chars"),
    )
    return rows, streams, binary


def reassemble_lines(
    chunks: DataFrame,
    stream: str | Sequence[str] = "stream_id",
    seq: str = "seq",
    data: str = "data",
    max_len: int | None = DEFAULT_CHUNK,
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Lines of an ordered chunk table: the stream columns, `line_no`, `piece_no`, `line`.

    A line may span any number of chunks, and is cut as in `cap_lines`, so no group
    ever holds more than `max_len` characters, even when a stream has no LF at all.
    With `max_len=None` every line is whole, there is no `piece_no`, and a line must
    fit in a row. NULL stream ids are one stream. `seq` must be unique within a
    stream and not NULL, or the job fails; it may have gaps of any size, as byte offsets
    have. Totals are taken in ranges of about `span` chunks. Binary chunks are cut by
    bytes, and their pieces are binary.
    """
    check_range("span", span, 1)
    if max_len is not None:
        check_range("max_len", max_len, 1)
    rows, streams, binary = chunk_rows(chunks, stream, seq, data)
    pieces = assemble(rows, max_len, span).filter(~F.col("open") | (F.col("line") != ""))
    line = F.col("line")
    if binary:
        line = F.encode(line, "ISO-8859-1")
        line = line.cast("string") if max_len is None else line
    numbers = ["line_no"] if max_len is None else ["line_no", "piece_no"]
    return pieces.select(
        *[F.col("ids")[name].alias(name) for name in streams], *numbers, line.alias("line")
    )
