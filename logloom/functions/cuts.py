"""Cutting texts into consecutive pieces, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(number: Column, size: int) -> Column:
    """Whole-number division, exact for every bigint."""
    return F.call_function("div", number, F.lit(size).cast("bigint"))


# One character per byte, both ways.
_BYTES = "ISO-8859-1"


def pieces_bytewise(text: Column, cut: Callable[[Column], Column]) -> Column:
    """`cut(text)`, an array of pieces, with every byte kept.

    Regular expressions replace bytes that are not UTF-8. A text that has such
    bytes is cut as one character per byte, and its pieces are turned back.
    """
    single = F.decode(text.cast("binary"), _BYTES)
    back = F.transform(cut(single), lambda piece: F.encode(piece, _BYTES).cast("string"))
    return F.when(F.is_valid_utf8(text), cut(text)).otherwise(back)


def text_bytewise(
    text: Column, change: Callable[[Column], Column], change_bytes: Callable[[Column], Column]
) -> Column:
    """`change(text)`, a text; texts that are not UTF-8 go through `change_bytes` in the same way."""
    single = F.decode(text.cast("binary"), _BYTES)
    back = F.encode(change_bytes(single), _BYTES).cast("string")
    return F.when(F.is_valid_utf8(text), change(text)).otherwise(back)


def text_length(text: Column) -> Column:
    """Characters of a text; in a text that is not UTF-8 every byte is one."""
    return F.when(F.is_valid_utf8(text), F.char_length(text)).otherwise(F.octet_length(text))


def char_pieces(text: Column, size: int) -> Column:
    """Array of consecutive pieces of `size` characters; empty for an empty text.

    One regular-expression pass is linear in the text. `substring` by character
    position would walk from the start of the text for every piece. In a text that
    is not UTF-8 every byte counts as a character.
    """
    every = F.lit(f"(?s).{{1,{size}}}")
    return pieces_bytewise(text, lambda t: F.regexp_extract_all(t, every, F.lit(0)))


def byte_blocks(data: Column, size: int) -> Column:
    """Array of consecutive binary blocks of exactly `size` bytes, the last one shorter."""
    count = F.ceil(F.octet_length(data) / size).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(data, i * size + 1, F.lit(size)),
    )
    return F.when(count > 0, blocks).otherwise(F.array().cast("array<binary>"))


def _char_start(data: Column, position: Column) -> Column:
    """Move a 0-based byte position back to the start of the character it falls in."""

    def inside_char(back: int) -> Column:
        byte = F.substring(data, position - back + 1, F.lit(1))
        return byte.between(F.lit(b"\x80"), F.lit(b"\xbf"))

    return (
        F.when(
            (position == 0) | ~inside_char(0) | (position >= F.octet_length(data)), position
        )
        .when(~inside_char(1), position - 1)
        .when(~inside_char(2), position - 2)
        .otherwise(position - 3)
    )


def byte_pieces(data: Column, size: int) -> Column:
    """Like `char_pieces`, over the UTF-8 bytes of a text and cut every `size` bytes.

    Cut k stands at byte k * size, moved back to a character start, so every
    piece can be computed from its own index and none splits a character.
    """
    count = F.ceil(F.octet_length(data) / size).cast("int")

    def piece(i: Column) -> Column:
        start = _char_start(data, i * size)
        stop = _char_start(data, (i + 1) * size)
        return F.substring(data, start + 1, stop - start).cast("string")

    pieces = F.transform(F.sequence(F.lit(0), count - 1), piece)
    return F.when(count > 0, pieces).otherwise(F.array().cast("array<string>"))


def byte_prefix(text: Column, budget: int) -> Column:
    """The longest start of `text` that fits in `budget` bytes and ends between characters."""
    data = text.cast("binary")
    stop = _char_start(data, F.lit(budget))
    return F.when(F.octet_length(text) <= budget, text).otherwise(
        F.substring(data, F.lit(1), stop).cast("string")
    )
