"""Operators over tables."""

from .audit import capture_audit, escape_profile
from .encode import (
    Encoder,
    csv_encoder,
    encode_ndjson,
    encode_with,
    json_encoder,
    truncate_encoded,
)
from .fields import (
    FieldError,
    FieldSet,
    fold_fields,
    inject_fields,
    join_field_sets,
    parse_fields,
    render_prefix,
    type_profile,
    validate_field_sets,
)
from .flow import shed, shed_report
from .framing import cap_lines, chunk_text, reassemble_lines, split_lines

__all__ = [
    "Encoder",
    "FieldError",
    "FieldSet",
    "cap_lines",
    "capture_audit",
    "chunk_text",
    "csv_encoder",
    "encode_ndjson",
    "encode_with",
    "escape_profile",
    "fold_fields",
    "inject_fields",
    "join_field_sets",
    "json_encoder",
    "parse_fields",
    "reassemble_lines",
    "render_prefix",
    "shed",
    "shed_report",
    "split_lines",
    "truncate_encoded",
    "type_profile",
    "validate_field_sets",
]
