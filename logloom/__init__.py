"""Log and text capture on Spark: lines, chunks, metadata fields and NDJSON records."""

from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import (
    capture,
    capture_frame,
    captured_field_sets,
    captured_ledger,
    captured_totals,
)
from .sinks import write_ndjson
from .sources import read_lines, stream_lines
from .streaming import (
    read_reassembled,
    read_shed,
    reassemble_stream,
    reassemble_timed,
    shed_stream,
    shed_stream_report,
)

__all__ = [
    *_operators,
    "capture",
    "capture_frame",
    "captured_field_sets",
    "captured_ledger",
    "captured_totals",
    "read_lines",
    "read_reassembled",
    "read_shed",
    "reassemble_stream",
    "reassemble_timed",
    "shed_stream",
    "shed_stream_report",
    "stream_lines",
    "write_ndjson",
]
