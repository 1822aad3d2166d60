"""Every registered ledger query against its SQL."""

from __future__ import annotations

import pytest

from ledgerloom.plans import catalog, edge_queries, engine_queries  # noqa: F401 (register their queries)
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        names, mine, other_names, other = both(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
        assert names == other_names and mine == other
        assert mine or name in ("orders_without_rows", "chain_first_break")
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
