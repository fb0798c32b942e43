"""Records: newline-delimited JSON and other line formats, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.escape import escape_json, truncate_escaped
from ..limits import MESSAGE_KEY, check_key
from .fields import FieldSet


@dataclass(frozen=True)
class Encoder:
    """A record format: what stands before, how the message is written, what follows.

    `prefix` and `postfix` get the constant fields of the run and are built once
    per run; `value` gets the message column.
    """

    prefix: Callable[[FieldSet], str | Column]
    value: Callable[[Column], Column]
    postfix: Callable[[FieldSet], str | Column]
    #: The key of the message, which no field may have.
    msg_key: str = MESSAGE_KEY


def json_encoder(msg_key: str = MESSAGE_KEY, strip_forced_quotes: bool = False) -> Encoder:
    """One JSON object per record: the fields in order, then the message."""
    check_key(msg_key)
    return Encoder(
        prefix=lambda fields: fields.prefix(msg_key, strip_forced_quotes),
        value=escape_json,
        postfix=lambda fields: '"}',
        msg_key=msg_key,
    )


def csv_encoder() -> Encoder:
    """One CSV row per record: the field values, then the message, all quoted."""

    def quoted(text: str) -> str:
        return '"' + text.replace('"', '""') + '"'

    return Encoder(
        prefix=lambda fields: "".join(quoted(val) + "," for _, val in fields.fields) + '"',
        value=lambda msg: F.replace(msg, F.lit('"'), F.lit('""')),
        postfix=lambda fields: '"',
    )


def _column(part: str | Column) -> Column:
    return F.lit(part) if isinstance(part, str) else part


def encode_with(
    df: DataFrame,
    msg_col: str,
    encoder: Encoder,
    fields: FieldSet | Iterable[str] | None = None,
    out_col: str = "record",
) -> DataFrame:
    """Add `out_col`: each message in the format of `encoder`. NULL messages give NULL."""
    constant = FieldSet.of(fields, encoder.msg_key)
    return df.withColumn(
        out_col,
        F.concat(
            _column(encoder.prefix(constant)),
            encoder.value(F.col(msg_col)),
            _column(encoder.postfix(constant)),
        ),
    )


def encode_ndjson(
    df: DataFrame,
    msg_col: str,
    fields: FieldSet | Iterable[str] | Column | None = None,
    msg_key: str = MESSAGE_KEY,
    out_col: str = "json",
    strip_forced_quotes: bool = False,
) -> DataFrame:
    """Add `out_col`: one JSON object per row, fields first and the message last.

    `fields` is the constant field set of the run, or a column with a rendered
    front (see `render_prefix`) where every source has its own set; NULL stands for
    no fields. No field may have the key `msg_key`.
    """
    encoder = json_encoder(msg_key, strip_forced_quotes)
    if isinstance(fields, Column):
        front = F.coalesce(fields, F.lit(FieldSet().prefix(msg_key)))
        encoder = Encoder(lambda _: front, encoder.value, encoder.postfix, msg_key)
        fields = None
    return encode_with(df, msg_col, encoder, fields, out_col)


def truncate_encoded(
    df: DataFrame, msg_col: str, budget: int, unit: str = "char", out_col: str = "encoded"
) -> DataFrame:
    """Add `out_col`: the escaped message, at most `budget` long, never inside an escape."""
    return df.withColumn(out_col, truncate_escaped(F.col(msg_col), budget, unit))
