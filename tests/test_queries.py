import pytest

from tests.compare import same
from tracelake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        same(spark, QUERIES[name], ORACLE_SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0
