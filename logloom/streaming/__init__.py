"""Operators over streams that keep state."""

from .reassemble import read_reassembled, reassemble_stream
from .shed import read_shed, shed_stream, shed_stream_report
from .timed import reassemble_timed

__all__ = [
    "read_reassembled",
    "read_shed",
    "reassemble_stream",
    "reassemble_timed",
    "shed_stream",
    "shed_stream_report",
]
