"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from tests.oracle import check

from juralake.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    check(spark, SF, QUERIES[name], ORACLE[name])


def test_entry_has_provenance(spark):
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.where("provenance is null").count() == 0 < d.count()
    assert set(e.oracle_sql()) <= set(e.queries())
