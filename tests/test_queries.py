"""Every query of the library against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest
from compare import assert_same

from perennial import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    assert_same(spark, SF, plans.QUERIES[name], plans.ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
