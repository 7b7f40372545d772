import pytest

from compare import same
from strandline.plans.oracle import SQL
from strandline.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert df.count() > 0
