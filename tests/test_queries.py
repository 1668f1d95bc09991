"""Every general query over empty tables, and over rows of nulls beside columns with clashing names."""

import pytest

from lakemill.queries.problems import R
from tests.tables import write


@pytest.mark.parametrize("nulls", [False, True], ids=["empty", "nulls"])
def test_problem_queries_on_bare_tables(spark, tmp_path, nulls):
    sf = write(spark, tmp_path / "sf", nulls)
    for name, q in R.queries.items():
        n = q(spark, sf).count()
        assert n == (2 if nulls and name == "p7_table" else 0), name


def test_queries_have_names_once_and_sql_where_it_can_be():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 75
