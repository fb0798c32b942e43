"""NDJSON sink."""

from .ndjson import write_ndjson

__all__ = ["write_ndjson"]
