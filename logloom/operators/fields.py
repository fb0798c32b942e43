"""Metadata fields: parsing, typing and folding `key=value` tables, and attaching them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.escape import LONG_CONTROL_ESCAPES, PRINTABLE_ESCAPES, SHORT_CONTROL_ESCAPES
from ..functions.literals import (
    BOOLEAN_TYPE,
    LITERAL_TYPES,
    NULL_TYPE,
    NUMBER,
    NUMBER_TYPE,
    STRING_TYPE,
    literal_type,
    render_literal,
)
from ..limits import (
    BAD_KEY,
    BAD_VALUE,
    KEY_ALPHABET,
    MAX_FIELDS,
    MAX_KEY_BYTES,
    MAX_VALUE_BYTES,
    MESSAGE_KEY,
    TOO_MANY,
    check_free,
    check_key,
    check_range,
    names,
    unused,
)
from ..session import settled

# Most digits of a DECIMAL.
MAX_PRECISION = 38

# Join parts per set: spreads the rows of one large set, or of one large source.
SALTS = 16

# The place of a field, as the folding of sets calls it.
_POS = "pos"

# Size up to which field sets are sent to every task, as JSON text.
BROADCAST_BYTES = 8 << 20


def parse_fields(
    df: DataFrame, kv_col: str, reserved: Sequence[str] = (MESSAGE_KEY,)
) -> DataFrame:
    """Add `key`, `val` and `error` for a `key=value` column.

    The first `=` splits; nothing is trimmed; lengths count bytes. A bad row is
    kept, with its error code and NULL key and value. The input may not have columns
    of these three names.
    """
    check_free(df.columns, ("key", "val", "error"))
    kv = F.col(kv_col)
    split_at = F.instr(kv, "=")
    key = F.substring(kv, F.lit(1), split_at - 1)
    # Past the `=`, to the end: no text is longer than the largest int.
    val = F.substring(kv, split_at + 1, F.lit(2**31 - 1))
    error = (
        F.when(kv.isNull() | (split_at <= 1), BAD_KEY)
        .when(F.octet_length(key) > MAX_KEY_BYTES, BAD_KEY)
        .when(~F.octet_length(val).between(1, MAX_VALUE_BYTES), BAD_VALUE)
        .when(~key.rlike(rf"^[{KEY_ALPHABET}]+\z") | key.isin(*reserved), BAD_KEY)
    )
    return df.withColumn("error", error).withColumns(
        {
            "key": F.when(F.col("error").isNull(), key),
            "val": F.when(F.col("error").isNull(), val),
        }
    )


def type_profile(kv_df: DataFrame, group_cols: str | Sequence[str], val_col: str) -> DataFrame:
    """Per group: how many values are of each inferred type, and the narrowest common type.

    NULL values (rows that did not parse) are not counted. `null` fits every
    type; two different other types only have `string` in common.
    """
    kinds = kv_df.select(*names(group_cols), literal_type(F.col(val_col)).alias("_type"))
    counts = kinds.groupBy(*names(group_cols)).agg(
        F.count("_type").alias("n_values"),
        *[F.count_if(F.col("_type") == kind).alias(f"n_{kind}") for kind in LITERAL_TYPES],
    )
    typed = F.col("n_values") - F.col("n_null")
    return counts.withColumn(
        "common_type",
        F.when(typed == 0, F.when(F.col("n_null") > 0, NULL_TYPE))
        .when(F.col("n_number") == typed, NUMBER_TYPE)
        .when(F.col("n_boolean") == typed, BOOLEAN_TYPE)
        .otherwise(STRING_TYPE),
    )


def _renamed(names: list[str]) -> list[Column]:
    return [F.col(name).alias(f"_{name}") for name in names]


def _same(names: list[str]) -> Column:
    """Equal to the renamed columns. NULL ids are equal too, so that no row is lost."""
    return reduce(and_, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names])


def _fold(kv_df: DataFrame, sets: list[str], pos: str, max_fields: int) -> DataFrame:
    """Per set: `fields`, `n_fields`, `error` and `error_pos`.

    The set is full at the first position of its `max_fields`-th distinct key,
    and any later row is an error. All steps are aggregations that combine
    before they shuffle. The ranking keeps `max_fields` keys per set, which
    Spark prunes in every partition before the shuffle.
    """
    check_free(sets, ("key", "val", "error", "pos", "error_pos", "fields", "n_fields"))
    rows = kv_df.select(*sets, F.col(pos).alias("pos"), "key", "val", "error")
    per_key = rows.groupBy(*sets, "key", "error").agg(
        F.min("pos").alias("pos"), F.max_by("val", "pos").alias("val")
    )
    # Errors come first; a set has at most one row per error code.
    rank = Window.partitionBy(*sets).orderBy(F.col("error").isNull(), "pos")
    is_field = F.col("error").isNull()
    firsts = (
        per_key.withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= max_fields + len((BAD_KEY, BAD_VALUE)))
        .groupBy(*sets)
        .agg(
            F.array_sort(
                F.collect_list(F.when(is_field, F.struct("pos", "key", "val")))
            ).alias("fields"),
            F.min(F.when(~is_field, F.col("pos"))).alias("bad_pos"),
            F.min_by("error", F.when(~is_field, F.col("pos"))).alias("bad"),
        )
        .withColumn("full_pos", F.get("fields", F.lit(max_fields - 1))["pos"])
    )
    # The first row after a set became full. Only full sets are looked up; a
    # large set is spread over several join parts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    full = firsts.filter(
        F.col("full_pos").isNotNull()
        & (F.col("bad_pos").isNull() | (F.col("bad_pos") > F.col("full_pos")))
    ).select(*_renamed(sets), "full_pos", salts.alias("_salt"))
    surplus = (
        rows.select(*sets, "pos", F.pmod(F.xxhash64("pos"), F.lit(SALTS)).alias("salt"))
        .join(full, _same(sets) & (F.col("salt") == F.col("_salt")))
        .filter(F.col("pos") > F.col("full_pos"))
        .groupBy(*[f"_{name}" for name in sets])
        .agg(F.min("pos").alias("surplus_pos"))
    )
    error_pos = F.coalesce("surplus_pos", "bad_pos")
    return (
        firsts.join(surplus, _same(sets), "left")
        .withColumn(
            "error",
            F.when(F.col("surplus_pos").isNotNull(), TOO_MANY).otherwise(F.col("bad")),
        )
        .withColumn("error_pos", error_pos)
        .withColumn(
            "n_fields",
            F.when(F.col("error_pos").isNull(), F.size("fields")).otherwise(
                F.size(F.filter("fields", lambda f: f["pos"] < F.col("error_pos")))
            ),
        )
        .select(
            *sets,
            F.when(F.col("error").isNull(), F.col("fields")).alias("fields"),
            F.least(F.col("n_fields"), F.lit(max_fields)).alias("n_fields"),
            "error",
            "error_pos",
        )
    )


def _parsed(kv_df: DataFrame, sets: list[str], pos: str, kv_col: str, msg_key: str) -> DataFrame:
    """The columns that folding needs, parsed; others of the table may have any names."""
    kv = unused(sets, "_kv")
    rows = kv_df.select(*sets, F.col(pos).alias(_POS), F.col(kv_col).alias(kv))
    check_free(sets, (_POS, "key", "val", "error"))
    return parse_fields(rows, kv, (msg_key,))


def fold_fields(
    kv_df: DataFrame,
    set_id: str | Sequence[str],
    pos: str,
    kv_col: str = "kv",
    max_fields: int = MAX_FIELDS,
    msg_key: str = MESSAGE_KEY,
) -> DataFrame:
    """One row per set: `fields` (array of `pos`, `key`, `val`), `error`, `error_pos`.

    A repeated key keeps its first position and its last value. The first error
    in order of `pos` decides the set, which then has no fields. `pos` must be
    unique within a set. `msg_key` is the key of the message, which no field may have.
    """
    check_range("max_fields", max_fields, 1)
    sets = names(set_id)
    folded = _fold(_parsed(kv_df, sets, pos, kv_col, msg_key), sets, _POS, max_fields)
    return folded.select(*sets, "fields", "error", "error_pos")


def validate_field_sets(
    kv_df: DataFrame,
    set_id: str | Sequence[str],
    pos: str,
    kv_col: str = "kv",
    max_fields: int = MAX_FIELDS,
    msg_key: str = MESSAGE_KEY,
) -> DataFrame:
    """Dry run: per set `ok`, `error`, `error_pos`, and `n_fields` accepted before the error."""
    check_range("max_fields", max_fields, 1)
    sets = names(set_id)
    folded = _fold(_parsed(kv_df, sets, pos, kv_col, msg_key), sets, _POS, max_fields)
    return folded.select(
        *sets, F.col("error").isNull().alias("ok"), "error", "error_pos", "n_fields"
    )


def render_prefix(
    fields: str | Column, msg_key: str = MESSAGE_KEY, strip_forced_quotes: bool = False
) -> Column:
    """The constant front of a record from a `fields` array; NULL counts as no fields."""
    check_key(msg_key)
    column = F.col(fields) if isinstance(fields, str) else fields
    rendered = F.transform(
        column,
        lambda f: F.concat(
            F.lit('"'), f["key"], F.lit('":'), render_literal(f["val"], strip_forced_quotes),
            F.lit(","),
        ),
    )
    text = F.coalesce(F.array_join(rendered, ""), F.lit(""))
    return F.concat(F.lit("{"), text, F.lit(f'"{msg_key}":"'))


def join_field_sets(
    df: DataFrame,
    folded: DataFrame,
    on: str | Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach the field set of its source to every row; rows without a set are kept.

    NULL sources meet the set of the NULL source. Give the `error` column of the
    folded sets along to see which rows belong to a set that failed: such a set
    has no fields. `encode_ndjson` writes the rows without a set as records
    without fields.

    The sets are settled first, as a table in the shared folder, and measured. Up to `broadcast_bytes` they are sent to every task,
    and the rows of `df` are not shuffled at all. Beyond that, the rows of a source
    are spread over `SALTS` join parts, each of which gets the sets once.
    """
    keys = names(on)
    # None of the columns that come from the other side, or are used on the way, may be there.
    check_free(df.columns, (*[f"_{key}" for key in keys], "_salt", "_part"))
    sets = settled(folded, "field-sets")
    size = sets.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0]
    # Other names on the right, so that NULL sources can be compared too.
    right = sets.withColumnsRenamed({key: f"_{key}" for key in keys})
    if (size or 0) <= broadcast_bytes:
        return df.join(F.broadcast(right), _same(keys), "left").drop(*[f"_{key}" for key in keys])
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # By the place of a row, whatever it holds: equal rows of a hot source are spread too.
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = df.withColumn("_salt", place)
    right = right.withColumn("_part", parts)
    return salted.join(right, _same(keys) & (F.col("_salt") == F.col("_part")), "left").drop(
        *[f"_{key}" for key in keys], "_salt", "_part"
    )


class FieldError(ValueError):
    """A constant field that is not valid; `code` is its error code."""

    def __init__(self, code: str, kv: str | None):
        super().__init__(f"{code}: {kv!r}")
        self.code = code


@dataclass(frozen=True)
class FieldSet:
    """The constant fields of one run, in order. At most `MAX_FIELDS`, so plain Python."""

    fields: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(
        cls, pairs: Iterable[str], max_fields: int = MAX_FIELDS, msg_key: str = MESSAGE_KEY
    ) -> FieldSet:
        """Read `key=value` texts in order, or raise FieldError at the first bad one."""
        found: dict[str, str] = {}
        for kv in pairs:
            if len(found) == max_fields:
                raise FieldError(TOO_MANY, kv)
            key, _, val = (kv or "").partition("=")
            if not key or "=" not in kv or len(key.encode()) > MAX_KEY_BYTES:
                raise FieldError(BAD_KEY, kv)
            if not 1 <= len(val.encode()) <= MAX_VALUE_BYTES:
                raise FieldError(BAD_VALUE, kv)
            if not re.fullmatch(f"[{KEY_ALPHABET}]+", key) or key == msg_key:
                raise FieldError(BAD_KEY, kv)
            found[key] = val
        return cls(tuple(found.items()))

    @classmethod
    def of(
        cls, fields: FieldSet | Iterable[str] | None, msg_key: str = MESSAGE_KEY
    ) -> FieldSet:
        """The field set itself, or one read from texts; without the key of the message."""
        if not isinstance(fields, FieldSet):
            return cls.parse(fields or (), msg_key=msg_key)
        for key, val in fields.fields:
            if key == msg_key:
                raise FieldError(BAD_KEY, f"{key}={val}")
        return fields

    def prefix(self, msg_key: str = MESSAGE_KEY, strip_forced_quotes: bool = False) -> str:
        """The constant front of every record, up to the opening quote of the message."""
        text = "".join(
            f'"{key}":{_render(val, strip_forced_quotes)},' for key, val in self.fields
        )
        return f'{{{text}"{msg_key}":"'

    def literals(self, typed: bool = True) -> dict[str, Column]:
        return {key: _literal(val) if typed else F.lit(val) for key, val in self.fields}


# The same rules as the column expressions, for the constants of a run.
_ESCAPES = str.maketrans(dict(PRINTABLE_ESCAPES + SHORT_CONTROL_ESCAPES + LONG_CONTROL_ESCAPES))
_NUMBER = re.compile(NUMBER.replace(r"\z", ""))


def _is_number(val: str) -> bool:
    return _NUMBER.fullmatch(val) is not None


def _render(val: str, strip_forced_quotes: bool) -> str:
    if val in ("true", "false", "null") or _is_number(val):
        return val
    if strip_forced_quotes and len(val) > 1 and val[0] == val[-1] == '"':
        val = val[1:-1]
    return '"' + val.translate(_ESCAPES) + '"'


def _literal(val: str) -> Column:
    if val in ("true", "false"):
        return F.lit(val == "true")
    if val == "null":
        return F.lit(None)
    if not _is_number(val):
        return F.lit(val)
    if re.fullmatch(r"-?[0-9]+", val) and -(2**63) <= int(val) < 2**63:
        return F.lit(int(val)).cast("bigint")
    exact = Decimal(val)
    if not re.fullmatch(r"-?[0-9]+", val) and Decimal(repr(float(val))) == exact:
        return F.lit(float(val))
    _, digits, exponent = exact.as_tuple()
    scale = max(-exponent, 0)
    precision = max(len(digits) + max(exponent, 0), scale)
    if precision <= MAX_PRECISION:
        return F.lit(val).cast(f"decimal({MAX_PRECISION},{scale})")
    return F.lit(val)


def inject_fields(
    df: DataFrame, fields: FieldSet | Iterable[str], typed: bool = True
) -> DataFrame:
    """Add the constant fields of a run to every row, as typed columns or as text.

    A number becomes BIGINT, or DOUBLE where that spells the same number, or else
    DECIMAL where its digits fit. All others stay text: no digit is lost, and none
    becomes infinite.
    """
    literals = FieldSet.of(fields).literals(typed)
    taken = sorted(set(literals) & set(df.columns))
    if taken:
        raise ValueError(f"the table already has columns {', '.join(taken)}")
    return df.withColumns(literals) if literals else df
