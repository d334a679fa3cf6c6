import pytest
from oracle import connect, differences

from codeloom import plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    assert not differences(spark, con, name, plans.QUERIES[name], plans.ORACLES[name], SMALL)
