import pytest
from check_oracles import compare, connect

from vulntide.catalog import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    same, note = compare(spark, duck, SF_DIR, name)
    assert same, note
