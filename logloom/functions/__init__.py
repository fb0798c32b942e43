"""Column expressions: escaping, cutting, and typed rendering of values."""

from .cuts import byte_blocks, byte_pieces, byte_prefix, char_pieces
from .escape import escape_count, escape_json, escaped_bytes, truncate_escaped
from .literals import literal_type, render_literal, unquote

__all__ = [
    "byte_blocks",
    "byte_pieces",
    "byte_prefix",
    "char_pieces",
    "escape_count",
    "escape_json",
    "escaped_bytes",
    "literal_type",
    "render_literal",
    "truncate_escaped",
    "unquote",
]
