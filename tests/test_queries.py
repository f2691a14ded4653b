"""Every query over the driver tables against its SQL."""

import pytest

from docloom import plans
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, plans.QUERIES[name], plans.SQL[name])


def test_entry_has_rows_and_names(spark):
    import __spark_entry__ as e

    assert {"scope_id", "id", "role", "text"} == set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
