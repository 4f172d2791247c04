"""Every registered query against its SQL counterpart on the small tables."""

import oracle
import pytest

import __spark_entry__ as entry
from peerlens.plans import catalog

QUERIES, SQLS = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert QUERIES.items() <= entry.queries().items() and SQLS.items() <= entry.oracle_sql().items()
    assert set(SQLS) <= set(QUERIES)
    assert set(QUERIES) - set(SQLS) == {"provenance"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name not in SQLS:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    why = oracle.compare(spark, con, QUERIES[name], SQLS[name], sf_dir)
    if why == "no rows":  # some checks find nothing in tables this small; both sides agree on it
        return
    assert why is None, why
