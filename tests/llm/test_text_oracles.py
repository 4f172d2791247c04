"""The operators that SQL can express against their SQL, and all of them as registered."""

import re

import oracle
import pytest

import __spark_entry__ as entry
from peerlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.compare(spark, oracle.connect(sf), QUERIES[name], ORACLES[name], sf) is None


def test_one_query_for_every_operator():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert ORACLES.items() <= entry.oracle_sql().items()
