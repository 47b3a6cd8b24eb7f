import pytest

from callweave.plans import queries  # noqa: F401  registers
from callweave.registry import FLAGSHIP, ORACLES, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, QUERIES[name], ORACLES[name], SF)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    """Their answers are compared with plain loops in the tests of their operators; here they have some."""
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries() and entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
