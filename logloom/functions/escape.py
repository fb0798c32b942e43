"""JSON string escaping as Spark column expressions.

The JVM's JSON writer escapes a text in one pass, but differs from the record
format in two points: hex digits in upper case, and DEL left alone. It also
replaces bytes that are not valid UTF-8. Nearly always one look at its result
shows that none of this matters. Where it does, the few escapes concerned are put
right with `replace`, as long as the text has no `\\u00` of its own that could be
mistaken for one. All other texts go through a chain of byte-level `replace`
calls, which keeps every byte but scans the text once per call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import UNITS, check_choice, check_range
from .cuts import byte_prefix, text_bytewise

# Bytes with a two-character escape. The backslash goes first,
# because the other replacements introduce backslashes.
PRINTABLE_ESCAPES = [("\\", "\\\\"), ('"', '\\"')]
SHORT_CONTROL_ESCAPES = [
    ("\b", "\\b"),
    ("\t", "\\t"),
    ("\n", "\\n"),
    ("\f", "\\f"),
    ("\r", "\\r"),
]
# Every other control character and DEL, as lower-case \u00xx.
_SHORT = {char for char, _ in SHORT_CONTROL_ESCAPES}
LONG_CONTROL_ESCAPES = [
    (chr(code), f"\\u{code:04x}") for code in [*range(32), 127] if chr(code) not in _SHORT
]

NEEDS_ESCAPE = r'[\x00-\x1f"\\\x7f]'

# Characters that the JSON writer treats differently: hex digits above 9, and DEL.
_DIFFERENT = r"[\x0b\x0e\x0f\x1a-\x1f\x7f]"
# The same without ESC, which starts the sequences of coloured terminal output
# and is by far the most frequent of them.
_DIFFERENT_BUT_ESC = r"[\x0b\x0e\x0f\x1a\x1c-\x1f\x7f]"
_ESC_CASE = [("\\u001B", "\\u001b")]
_CASES = [
    (escape.replace(escape[2:], escape[2:].upper()), escape)
    for _, escape in LONG_CONTROL_ESCAPES
    if escape[2:] != escape[2:].upper()
]
_DEL = [("\x7f", "\\u007f")]


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def _json_body(text: Column) -> Column:
    """The text as the JVM's JSON writer escapes it, out of `{"m":"..."}`."""
    written = F.to_json(F.struct(text.alias("m")))
    # As bytes, because cutting by position would count characters.
    size = F.octet_length(written) - len('{"m":""}')
    return F.substring(written.cast("binary"), F.lit(len('{"m":"') + 1), size).cast("string")


def escape_json(text: Column) -> Column:
    """`text` as the inside of a JSON string literal."""
    body, long_escape = _json_body(text), F.lit("\\u00")
    valid = F.is_valid_utf8(text)
    clear = valid & ~F.contains(text, long_escape)
    same = ~F.contains(body, long_escape) & ~F.contains(body, F.lit("\x7f")) & valid
    return (
        F.when(same | (valid & ~text.rlike(_DIFFERENT)), body)
        .when(clear & ~text.rlike(_DIFFERENT_BUT_ESC), _replace_all(body, _ESC_CASE))
        .when(clear, _replace_all(body, _CASES + _DEL))
        .otherwise(
            _replace_all(text, PRINTABLE_ESCAPES + SHORT_CONTROL_ESCAPES + LONG_CONTROL_ESCAPES)
        )
    )


def escaped_bytes(text: Column) -> Column:
    """Size in bytes of the escaped text."""
    return F.octet_length(escape_json(text))


def escape_count(text: Column) -> Column:
    """Number of characters of `text` that need an escape."""
    return F.regexp_count(text, F.lit(NEEDS_ESCAPE))


# An escape sequence that the end of the text cuts short: an odd backslash,
# followed by nothing or by an unfinished \u00xx. Group 1 keeps the complete
# backslash pairs in front of it.
_CUT_ESCAPE = r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-f]{0,3})?\z"


def truncate_escaped(text: Column, budget: int, unit: str = "char") -> Column:
    """Escaped text of at most `budget` units that never ends inside an escape.

    Every character takes at least one unit once escaped, so only the first
    `budget` units of the message can appear in the result and only those are
    escaped. In a text that is not UTF-8 every byte counts as a character.
    """
    check_range("budget", budget, 0)
    check_choice("unit", unit, UNITS)

    def truncated(part: Column) -> Column:
        if unit == "char":
            cut = F.substring(escape_json(F.substring(part, 1, budget)), 1, budget)
        else:
            cut = byte_prefix(escape_json(byte_prefix(part, budget)), budget)
        return F.regexp_replace(cut, _CUT_ESCAPE, "$1")

    def truncated_bytes(part: Column) -> Column:
        # One character per byte here, so both units are the same.
        cut = F.substring(escape_json(F.substring(part, 1, budget)), 1, budget)
        return F.regexp_replace(cut, _CUT_ESCAPE, "$1")

    return text_bytewise(text, truncated, truncated_bytes)
