"""Every registered query against its SQL counterpart on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = duck.execute(contract.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in result.description}
    assert sorted(types) == columns
    assert {c: TYPES.get(t, t) for c, t in frame.dtypes} == types
    order = [list(types).index(column) for column in columns]
    want = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    got = sorted(map(tuple, frame.select(*columns).collect()), key=repr)
    assert len(got) == len(want) and got == want
    assert not any(isinstance(v, float) and math.isinf(v) for row in got for v in row)


def test_entry(spark):
    assert contract.entry(spark).count() == 200
