"""Type inference and rendering of metadata values, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .escape import escape_json

# Fixed value: the JSON number grammar. `\z`, because `$` also accepts a line
# feed after the number.
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"

NUMBER_TYPE, BOOLEAN_TYPE, NULL_TYPE, STRING_TYPE = "number", "boolean", "null", "string"
LITERAL_TYPES = (NUMBER_TYPE, BOOLEAN_TYPE, NULL_TYPE, STRING_TYPE)


def literal_type(value: Column) -> Column:
    """`number`, `boolean`, `null` or `string`; NULL for a NULL value."""
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value.isin("true", "false"), BOOLEAN_TYPE)
        .when(value == "null", NULL_TYPE)
        .when(value.rlike(NUMBER), NUMBER_TYPE)
        .otherwise(STRING_TYPE)
    )


def unquote(value: Column) -> Column:
    """Drop one pair of surrounding double quotes, as in `"123"`."""
    return F.regexp_replace(value, r'(?s)^"(.*)"\z', "$1")


def render_literal(value: Column, strip_forced_quotes: bool = False) -> Column:
    """The value as JSON text: numbers, booleans and null verbatim, the rest quoted."""
    text = unquote(value) if strip_forced_quotes else value
    quoted = F.concat(F.lit('"'), escape_json(text), F.lit('"'))
    return F.when(literal_type(value) == STRING_TYPE, quoted).otherwise(value)

