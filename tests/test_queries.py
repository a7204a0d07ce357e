"""Every query of the library against its SQL on the smallest tables; those without SQL run and return rows."""

import pytest
from compare import same

from lakeglean.plans import BOOKS

QUERIES = {n: q for b in BOOKS for n, q in b.queries.items()}
ORACLES = {n: s for b in BOOKS for n, s in b.oracles.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_names_are_unique():
    assert len(QUERIES) == sum(len(b.queries) for b in BOOKS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
