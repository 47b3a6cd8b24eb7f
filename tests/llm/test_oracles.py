import pytest

from callweave.llm.queries import ORACLES, QUERIES
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]
