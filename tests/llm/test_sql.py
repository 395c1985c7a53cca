import pytest
from checking import difference

from tastegraph.llm.checks import CHECKS
from tastegraph.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir), duck, CHECKS[name]) is None
