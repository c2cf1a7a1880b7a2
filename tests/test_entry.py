from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert entry.entry(spark).limit(1).count() == 1
