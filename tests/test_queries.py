"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import compare
import pytest

from sheaf.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours = QUERIES[name](spark, SF).toArrow().to_pylist()
    if name in ORACLE_SQL:
        assert not compare.differences(ours, compare.duck(SF, ORACLE_SQL[name]))
    else:
        assert isinstance(ours, list)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
