"""Every registered query against its DuckDB oracle on the smallest test tables."""

import pytest

from quire.plans import ORACLE, QUERIES
from tools.oracle_check import compare, duck

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    _, status, n_spark, n_duck, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert status in ("ok", "rows-only"), f"{name}: {status}"
    assert n_spark is not None


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_result_types_match_oracle(spark, con, name):
    st = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType))
          for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    rel = con.sql(ORACLE[name])
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert st == dt
