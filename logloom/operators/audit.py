"""Audits: nothing lost or invented between stages, and how much a corpus grows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.escape import escape_count, escaped_bytes
from ..limits import MESSAGE_KEY, check_free, names
from .framing import cap_lines


def capture_audit(
    raw: DataFrame,
    encoded: DataFrame,
    group: str | Sequence[str],
    line_col: str = "line",
    json_col: str = "json",
    msg_key: str = MESSAGE_KEY,
    line_key: str | Sequence[str] | None = None,
    max_len: int | None = None,
    unit: str = "char",
) -> DataFrame:
    """Per group: what went in, what came out, and whether it balances.

    `raw` has one row per line, `encoded` one row per record with `piece_no`.
    The messages are read back from the records, byte by byte, so they need not be UTF-8.
    `balanced` says that every line is there and that the messages have as many bytes as
    the lines. Groups found on one side only are kept and do not balance.
    `bytes_out` counts the line feed of every record.

    With `line_key`, columns that both sides have (none of them also compares contents),
    `balanced` further says that the messages are the lines themselves: `digest_in` and
    `digest_out` are sums of hashes of the key, the number and the bytes of every piece, which
    do not depend on any order. Lines are cut as `cap_lines` cuts them, to
    `max_len` of `unit`; without it every record holds a whole line.
    """
    keys = names(group)
    check_free(keys, ("lines", "pieces", "bytes_in", "bytes_out", "growth", "balanced", "digest_in", "digest_out"))
    before = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length(line_col).cast("bigint")).alias("bytes_in"),
    )
    # One character per byte: JSON of any bytes can be read then, and gives them back.
    schema = T.StructType([T.StructField(msg_key, T.StringType())])
    as_chars = F.decode(F.col(json_col).cast("binary"), "ISO-8859-1")
    message = F.from_json(as_chars, schema)[msg_key]
    check_free(encoded.columns, ("_message",))
    read = encoded.withColumn("_message", message)
    after = read.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pieces"),
        F.count_if(F.col("piece_no") == 0).alias("_lines"),
        F.sum(F.char_length("_message").cast("bigint")).alias("_bytes"),
        F.sum(F.octet_length(json_col).cast("bigint") + 1).alias("bytes_out"),
        *([] if line_key is None else [_digest(line_key, F.col("_message")).alias("digest_out")]),
    )
    # Other names on the right, because both sides may come from one table.
    after = after.withColumnsRenamed({key: f"_{key}" for key in keys})
    same_group = reduce(
        and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    )
    joined = before.join(after, same_group, "full_outer")
    same = F.lit(True)
    if line_key is not None:
        pieces = (
            raw.withColumn("piece_no", F.lit(0).cast("bigint"))
            if max_len is None
            else cap_lines(raw, max_len, unit, line_col)
        )
        whole = F.decode(F.col(line_col).cast("binary"), "ISO-8859-1")
        digests = pieces.groupBy(*keys).agg(_digest(line_key, whole).alias("digest_in"))
        digests = digests.withColumnsRenamed({key: f"_in_{key}" for key in keys})
        joined = joined.join(
            digests, reduce(and_, [F.col(key).eqNullSafe(F.col(f"_in_{key}")) for key in keys]), "left"
        )
        same = F.col("digest_in").eqNullSafe(F.col("digest_out"))

    def count(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    return joined.select(
        *[F.coalesce(F.col(key), F.col(f"_{key}")).alias(key) for key in keys],
        count("lines").alias("lines"),
        count("pieces").alias("pieces"),
        count("bytes_in").alias("bytes_in"),
        count("bytes_out").alias("bytes_out"),
        F.try_divide("bytes_out", "bytes_in").alias("growth"),
        *([] if line_key is None else ["digest_in", "digest_out"]),
        (
            (count("lines") == count("_lines")) & (count("bytes_in") == count("_bytes")) & same
        ).alias("balanced"),
    )


def _digest(line_key: str | Sequence[str], chars: Column) -> Column:
    """Sum of the hashes of pieces. Sums of so many 64-bit numbers fit in 38 digits."""
    # As texts and longs, whatever types the two sides have.
    keys = [F.col(key).cast("string") for key in names(line_key)]
    piece = F.xxhash64(*keys, F.col("piece_no").cast("bigint"), chars)
    return F.sum(piece.cast("decimal(38,0)"))


# Size classes: the corpora aim at 64, 256 and 1024 characters; the borders are
# the geometric means. Escape classes: 0, 10 and 25 % of the characters; the
# border is the mean, in thousandths.
SIZE_BORDERS = [("short", 128), ("medium", 512)]
ESCAPE_BORDER = 175


def escape_profile(
    df: DataFrame, msg_col: str, group: str | Sequence[str] = ()
) -> DataFrame:
    """Per group, size class and escape class: `n_rows`, bytes raw and encoded, and growth."""
    keys = names(group)
    msg = F.col(msg_col)
    size_class = F.lit("long")
    for name, border in reversed(SIZE_BORDERS):
        size_class = F.when(F.char_length(msg) <= border, name).otherwise(size_class)
    measured = df.filter(msg.isNotNull()).select(
        *keys,
        size_class.alias("size_class"),
        F.char_length(msg).cast("bigint").alias("chars"),
        escape_count(msg).cast("bigint").alias("escapes"),
        F.octet_length(msg).cast("bigint").alias("bytes"),
        escaped_bytes(msg).cast("bigint").alias("encoded"),
    )
    escape_class = (
        F.when(F.col("escapes") == 0, "plain")
        .when(F.col("escapes") * 1000 <= F.col("chars") * ESCAPE_BORDER, "escaped")
        .otherwise("highly_escaped")
    )
    return (
        measured.groupBy(*keys, "size_class", escape_class.alias("escape_class"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("bytes").alias("bytes_raw"),
            F.sum("encoded").alias("bytes_encoded"),
        )
        .withColumn("growth", F.try_divide("bytes_encoded", "bytes_raw"))
    )
