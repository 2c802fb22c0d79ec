"""Every registered query against its SQL counterpart, over a whole fixture."""

import pytest
from tests.conftest import SMALL, bag, spark_bag

import __spark_entry__ as contract
from fleetlens import registry

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()
SPARK_TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
    "DATE": "date", "BOOLEAN": "boolean",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    types = {c[0]: SPARK_TYPES[str(c[1])] for c in cursor.description}
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == types
    assert spark_bag(df) == bag(columns, expected)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
