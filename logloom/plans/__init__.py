"""Whole jobs put together from the operators."""

from .capture import (
    capture,
    capture_frame,
    captured_field_sets,
    captured_ledger,
    captured_totals,
)

__all__ = [
    "capture",
    "capture_frame",
    "captured_field_sets",
    "captured_ledger",
    "captured_totals",
]
