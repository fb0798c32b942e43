"""Limits of the capture format and the argument checks built on them."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Fixed values of the format.
MAX_FIELDS = 32
MAX_KEY_BYTES = 32
MAX_VALUE_BYTES = 512
MIN_CHUNK, DEFAULT_CHUNK, MAX_CHUNK = 1024, 16384, 131072
MIN_BUFFER, DEFAULT_BUFFER, MAX_BUFFER = 1, 64, 1024
MESSAGE_KEY = "msg"

# Error codes that a row can carry.
BAD_KEY = "EINV_FIELD_KEY"
BAD_VALUE = "EINV_FIELD_VAL"
TOO_MANY = "ETOO_MANY_FIELD"

# Fixed value: the alphabet of field keys.
KEY_ALPHABET = "A-Za-z0-9_-"

UNITS = ("char", "byte")
POLICIES = ("wait", "drop")


def check_range(name: str, value: int, low: int, high: int | None = None) -> int:
    """Return `value`, or raise ValueError when it is outside [low, high]."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer, got {value!r}")
    if value < low or (high is not None and value > high):
        upper = "" if high is None else f" and at most {high}"
        raise ValueError(f"{name} must be at least {low}{upper}, got {value}")
    return value


def check_choice(name: str, value: str, choices: tuple[str, ...]) -> str:
    """Return `value`, or raise ValueError when it is not one of `choices`."""
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}, got {value!r}")
    return value


def check_unit(unit: str, size: int) -> None:
    """Byte cuts move back by up to 3 bytes, so a byte size needs room for one character."""
    check_choice("unit", unit, UNITS)
    check_range("size", size, 4 if unit == "byte" else 1)


def check_free(columns: list[str], taken: tuple[str, ...]) -> None:
    """Raise ValueError when one of `columns` has a name that the operator itself uses."""
    clash = sorted(set(columns) & set(taken))
    if clash:
        raise ValueError(f"rename the columns {', '.join(clash)}; the operator uses these names")


def unused(columns: Sequence[str], name: str) -> str:
    """`name`, with underscores in front until none of `columns` has it."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def names(columns: str | Sequence[str]) -> list[str]:
    """Column names given as one name or as several."""
    return [columns] if isinstance(columns, str) else list(columns)


def check_key(key: str) -> str:
    """Return `key`, or raise ValueError when a record cannot have it as a key."""
    if len(key.encode()) > MAX_KEY_BYTES or not re.fullmatch(f"[{KEY_ALPHABET}]+", key):
        raise ValueError(f"a key has 1 to {MAX_KEY_BYTES} characters of {KEY_ALPHABET}, got {key!r}")
    return key
