"""Field parsing, typing, folding and attaching."""

import random

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logloom import (
    FieldError,
    FieldSet,
    encode_ndjson,
    fold_fields,
    inject_fields,
    join_field_sets,
    parse_fields,
    render_prefix,
    type_profile,
    validate_field_sets,
)

KEY, VAL, MANY = "EINV_FIELD_KEY", "EINV_FIELD_VAL", "ETOO_MANY_FIELD"
K32 = "01234567890123456789012345678912"

PAIRS = [
    ("key1=value", "key1", "value", None),
    ("key2=va", "key2", "va", None),
    ("key3= ", "key3", " ", None),
    ("key4= v ", "key4", " v ", None),
    ("key5='val\"", "key5", "'val\"", None),
    ("key6=\\uD83E\\uDDEA", "key6", "\\uD83E\\uDDEA", None),
    ("key7=ŵèéêëěẽēėęřțťþtýŷÿy", "key7", "ŵèéêëěẽēėęřțťþtýŷÿy", None),
    (K32 + "=v", K32, "v", None),
    ("a=b=c", "a", "b=c", None),
    ("a_-Z9=\n", "a_-Z9", "\n", None),
    ("", None, None, KEY),
    (None, None, None, KEY),
    ("noequals", None, None, KEY),
    ("=", None, None, KEY),
    ("=value", None, None, KEY),
    (" =value", None, None, KEY),
    (".=value", None, None, KEY),
    ("këy=value", None, None, KEY),
    ("key\n=value", None, None, KEY),
    (K32 + "0=v", None, None, KEY),
    (K32 + "0=", None, None, KEY),
    ("key-1=", None, None, VAL),
    (".=", None, None, VAL),
    ("msg=x", None, None, KEY),
    ("key-2=x", "key-2", "x", None),
    ("key-3=" + "x" * 512, "key-3", "x" * 512, None),
    ("key-4=" + "x" * 513, None, None, VAL),
    ("key-5=" + "é" * 256, "key-5", "é" * 256, None),
    ("key-6=" + "é" * 257, None, None, VAL),
]


def test_parse_cases(spark):
    rows = spark.createDataFrame(PAIRS, "kv string, k string, v string, e string")
    for row in parse_fields(rows, "kv").collect():
        assert (row.key, row.val, row.error) == (row.k, row.v, row.e), row.kv


def test_constant_fields_follow_the_same_rules():
    for kv, key, val, error in PAIRS:
        if error is None:
            assert FieldSet.parse([kv]).fields == ((key, val),)
        else:
            with pytest.raises(FieldError) as caught:
                FieldSet.parse([kv])
            assert caught.value.code == error


def sets_frame(spark, sets):
    rows = [(s, p, kv) for s, kvs in sets.items() for p, kv in enumerate(kvs, 1)]
    return spark.createDataFrame(rows, "set_id string, pos bigint, kv string")


def walk(kvs, cap=32):
    """The rule itself: one pair after the other."""
    found = {}
    for pos, kv in enumerate(kvs, 1):
        try:
            if len(found) == cap:
                raise FieldError(MANY, kv)
            ((key, val),) = FieldSet.parse([kv]).fields
        except FieldError as error:
            return None, error.code, pos, len(found)
        found[key] = val
    return list(found.items()), None, None, len(found)


def check(spark, sets, cap=32):
    frame = sets_frame(spark, sets)
    folded = {r.set_id: r for r in fold_fields(frame, "set_id", "pos", max_fields=cap).collect()}
    valid = {r.set_id: r for r in validate_field_sets(frame, "set_id", "pos", max_fields=cap).collect()}
    assert set(folded) == set(valid) == set(sets)
    for name, kvs in sets.items():
        fields, error, pos, count = walk(kvs, cap)
        row = folded[name]
        got = None if row.fields is None else [(f.key, f.val) for f in row.fields]
        assert (got, row.error, row.error_pos) == (fields, error, pos), name
        row = valid[name]
        assert (row.ok, row.error, row.error_pos, row.n_fields) == (error is None, error, pos, count)


def test_set_cases(spark):
    k32 = [f"k{i:02d}=v" for i in range(1, 33)]
    check(
        spark,
        {
            "same key twice": ["key-1=value-1", "key-1=value-1"],
            "32 keys": k32,
            "33 keys": [*k32, "k33=v"],
            "last value, first place": ["a=1", "b=2", "a=3"],
            "repeat after the cap": [*k32, "k05=w"],
            "repeat before the cap": [*k32[:31], "k01=w", "k32=v"],
            "bad pair after the cap": [*k32, "=x"],
            "bad pair at the end": [*k32[:31], "k01=", "k32=v", "k33=v"],
            "bad only": ["="],
            "two bad": ["a=1", "b=", "=c"],
            None: [*k32, "k33=v"],
        },
    )


def test_small_cap(spark):
    check(spark, {"third key": ["key-1=v", "key-2=v", "key-3=v"], "one": ["key-1=v"]}, cap=2)


def test_random_sets_against_the_walk(spark):
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        keys = rng.randint(1, 9)
        kvs = [f"k{rng.randrange(keys)}={rng.randrange(100)}" for _ in range(rng.randint(1, 25))]
        if i % 3 == 0:
            kvs[rng.randrange(len(kvs))] = rng.choice(["bad", "x=", "msg=1"])
        sets[f"s{i}"] = kvs
    check(spark, sets, cap=5)


def test_one_set_that_is_most_of_the_table(spark):
    n = 20000
    big = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("set_id"),
        F.col("id").alias("pos"),
        F.concat(F.lit("k"), F.col("id") % 37, F.lit("="), F.col("id")).alias("kv"),
    )
    rows = {r.set_id: r for r in fold_fields(big, "set_id", "pos").collect()}
    assert len(rows) == 11
    in_order = [i for i in range(n) if i % 10 < 8]
    seen = set()
    for pos in in_order:
        if len(seen) == 32:
            break
        seen.add(pos % 37)
    assert (rows["hot"].error, rows["hot"].error_pos) == (MANY, pos)


def test_ranking_of_keys_is_pruned_before_the_shuffle(spark):
    frame = sets_frame(spark, {"a": ["k=1"]})
    plan = fold_fields(frame, "set_id", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_type_profile(spark):
    rows = spark.createDataFrame(
        [
            ("n", "1"), ("n", "2.5"), ("n", "null"),
            ("b", "true"), ("b", "false"),
            ("z", "null"),
            ("m", "1"), ("m", "true"),
            ("s", "x"), ("s", "null"),
            ("e", None),
        ],
        "key string, val string",
    )
    got = {r.key: r for r in type_profile(rows, "key", "val").collect()}
    assert {k: r.common_type for k, r in got.items()} == {
        "n": "number", "b": "boolean", "z": "null", "m": "string", "s": "string", "e": None,
    }
    assert (got["n"].n_values, got["n"].n_number, got["n"].n_null) == (3, 2, 1)


def test_inject_fields_typed_and_as_text(spark):
    fields = ["env=prod", "run=42", "rate=1.5e-3", "live=true", "gone=null", "big=123456789012345678901"]
    typed = inject_fields(spark.range(1), fields)
    assert dict(typed.dtypes) == {
        "id": "bigint", "env": "string", "run": "bigint", "rate": "double",
        "live": "boolean", "gone": "void", "big": "decimal(38,0)",
    }
    row = typed.first()
    assert (row.run, row.rate, row.live, row.gone) == (42, 0.0015, True, None)
    assert inject_fields(spark.range(1), fields, typed=False).first().rate == "1.5e-3"
    with pytest.raises(ValueError):
        inject_fields(spark.range(1), ["id=1"])
    with pytest.raises(FieldError):
        inject_fields(spark.range(1), ["bad key!=value"])


def test_join_field_sets_keeps_rows_without_a_set(spark):
    sets = fold_fields(sets_frame(spark, {"a": ["x=1", "y=b"]}), "set_id", "pos")
    rows = spark.createDataFrame([("a", "m1"), ("b", "m2")], "set_id string, m string")
    joined = join_field_sets(rows, sets.select("set_id", "fields"), "set_id")
    got = encode_ndjson(joined, "m", render_prefix("fields"))
    assert {r.set_id: r.json for r in got.collect()} == {
        "a": '{"x":1,"y":"b","msg":"m1"}',
        "b": '{"msg":"m2"}',
    }


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_join_field_sets_meets_null_sources_and_shows_failed_sets(spark, limit):
    kv = [("a", 0, "x=1"), (None, 0, "n=1"), ("bad", 0, "=no")]
    sets = fold_fields(spark.createDataFrame(kv, "set_id string, pos bigint, kv string"), "set_id", "pos")
    sets = sets.select("set_id", render_prefix("fields").alias("front"), "error")
    rows = spark.createDataFrame([("a", "m"), (None, "m"), ("bad", "m"), ("other", "m")], "set_id string, m string")
    joined = join_field_sets(rows, sets, "set_id", broadcast_bytes=limit)
    got = {r.set_id: (r.json, r.error) for r in encode_ndjson(joined, "m", F.col("front")).collect()}
    assert got == {
        "a": ('{"x":1,"msg":"m"}', None), None: ('{"n":1,"msg":"m"}', None),
        "bad": ('{"msg":"m"}', "EINV_FIELD_KEY"), "other": ('{"msg":"m"}', None),
    }
    plan = joined._jdf.queryExecution().executedPlan().toString()
    if limit:
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    else:
        assert "_salt" in plan


@pytest.mark.parametrize(
    "val, kind",
    [
        ("9" * 38, "decimal(38,0)"), ("-" + "9" * 38, "decimal(38,0)"), ("9" * 39, "string"),
        ("0.12345678901234567890", "decimal(38,20)"), ("1e400", "string"), ("1e20", "double"),
        ("12.5", "double"), ("1e-7", "double"), ("123456789012345678901.5", "decimal(38,1)"),
        ("-0", "bigint"), ("9223372036854775808", "decimal(38,0)"), ("1e-400", "string"),
    ],
)
def test_no_digit_of_a_number_is_lost(spark, val, kind):
    frame = inject_fields(spark.range(1), [f"v={val}"])
    assert dict(frame.dtypes)["v"] == kind
    assert Decimal(str(frame.first().v)) == Decimal(val)


def test_field_sets_beyond_the_broadcast_size_join_rows_with_maps(spark):
    sets = spark.createDataFrame([("a", "A"), (None, "N")], "src string, front string")
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "src string, n int")
    rows = rows.withColumn("m", F.create_map("n", "src"))
    small = join_field_sets(rows, sets, "src").select("src", "n", "front")
    large = join_field_sets(rows, sets, "src", broadcast_bytes=0)
    assert sorted(map(repr, large.select("src", "n", "front").collect())) == sorted(map(repr, small.collect()))
    assert large.columns == [*rows.columns, "front"]
    with pytest.raises(ValueError):
        join_field_sets(rows.withColumn("_salt", F.lit(1)), sets, "src")


def test_columns_of_the_input_are_not_overwritten(spark):
    rows = spark.createDataFrame([(1, 0, "a=1", "mine")], "id int, pos int, kv string, key string")
    with pytest.raises(ValueError):
        parse_fields(rows, "kv")
    folded = fold_fields(rows.withColumn("error", F.lit(5)), "id", "pos").collect()
    assert [(f["key"], f["val"]) for f in folded[0]["fields"]] == [("a", "1")]
    with pytest.raises(ValueError):
        fold_fields(rows, "key", "pos")
