import pytest

import __spark_entry__ as contract
from oracle import connect, differences
from podlens.plans.oracles import ORACLES
from podlens.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert REGISTRY.keys() == ORACLES.keys()
    assert contract.queries().items() >= REGISTRY.items()


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, con, name):
    assert differences(spark, name, SF_DIR, con) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
