"""Text sources."""

from .text import read_lines, stream_lines

__all__ = ["read_lines", "stream_lines"]
