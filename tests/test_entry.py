"""The driver's contract."""

import __spark_entry__ as e
from wardline.plans import catalog


def test_flagship_and_names(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 12 and {r.grp for r in rows} == {"all", "minor", "adult"}
    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and set(catalog.QUERIES) <= set(queries)
