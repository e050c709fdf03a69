"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from corpusloom.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import mismatch

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert mismatch(spark, QUERIES[name], ORACLE_SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert len(QUERIES[name](spark, SMALL).take(5)) >= (0 if name == "issue_list" else 1)
