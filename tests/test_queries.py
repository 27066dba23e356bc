"""Every core query with SQL against that SQL, over whole tables."""

import os

import pytest

import oracle
from keyloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLES:
        assert oracle.compare(name, df, con, registry.ORACLES[name]) == ""
    else:
        df.collect()
