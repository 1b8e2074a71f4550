import check_oracles
import pytest

from vulntide.llm.oracles import ORACLES
from vulntide.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_twin(spark, monkeypatch, name, sf_dir):
    monkeypatch.setitem(check_oracles.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(check_oracles.ORACLES, name, ORACLES[name])
    same, note = check_oracles.compare(spark, check_oracles.connect(sf_dir), sf_dir, name)
    assert same, note
