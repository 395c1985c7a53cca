import pytest
from checking import difference

from tastegraph.plans.catalog import QUERIES
from tastegraph.plans.checks import CHECKS


def test_every_check_has_a_query():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir), duck, CHECKS[name]) is None
