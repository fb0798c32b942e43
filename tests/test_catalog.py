"""Every query of the catalog against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from logloom.plans import catalog, oracle

# DuckDB's names for the Spark types that the results use.
TYPES = {
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = tables.execute(contract.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in frame.dtypes} == types
    order = [list(types).index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    got = sorted(repr(tuple(row)) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_entry_reads_the_smallest_tables(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["doc_id", "line_no", "json"] and frame.count() > 0
