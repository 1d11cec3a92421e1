"""Every query of the core against its SQL; those without run and have rows."""

from __future__ import annotations

import pytest

from quernel.queries import scale, tables, texts

PARTS = (tables, texts, scale)
SQL = {n: (p.QUERIES[n], s) for p in PARTS for n, s in p.SQL.items()}
REST = {n: q for p in PARTS for n, q in p.QUERIES.items() if n not in SQL}


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(name, same):
    same(*SQL[name])


@pytest.mark.parametrize("name", REST)
def test_runs(name, spark):
    assert REST[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
