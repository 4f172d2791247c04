"""Ordered scans against brute force, with runs far shorter than the groups."""

import random

from peerlens.functions.scans import carry_forward, running_sum


def fixture():
    rnd = random.Random(7)
    rows = []
    for key, n in (("hot", 97), ("b", 5), ("c", 1)):
        rows += [(key, r, rnd.choice([None, None, None, r * 10]), rnd.randint(0, 3)) for r in range(n)]
    return rows


def test_carry_forward(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "k string, r bigint, v bigint, n int")
    for block in (1, 4, 1000):
        got = {(x.k, x.r): x.last for x in carry_forward(df, ["k"], "r", {"last": "v"}, block).collect()}
        state = {}
        for k, r, v, _ in rows:
            state[k] = v if v is not None else state.get(k)
            assert got[(k, r)] == state[k], (block, k, r)


def test_running_sum(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "k string, r bigint, v bigint, n int")
    for block in (1, 4, 1000):
        got = {(x.k, x.r): x.total for x in running_sum(df, ["k"], "r", {"total": "n"}, block).collect()}
        state = {}
        for k, r, _, n in rows:
            state[k] = state.get(k, 0) + n
            assert got[(k, r)] == state[k]
