"""Every query of this package against its SQL where there is one, over whole tables."""

import os

import pytest

import oracle
from keyloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.ORACLES:
        assert oracle.compare(name, df, oracle.connect(SF), queries.ORACLES[name]) == ""
    else:
        df.collect()
