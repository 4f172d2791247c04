import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from llm.cases import odd_documents, rows_by_id
from peerlens.llm import mixing
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, fixed = {}, set()
    while True:
        rest = sum(size.values()) - sum(goal[s] for s in fixed)
        left = sum(weight[s] for s in names if s not in fixed)
        over = set()
        for s in names:
            if s not in fixed:
                goal[s] = rest * weight[s] / left
                if goal[s] > 3 * size[s]:
                    over.add(s)
        if not over:
            return goal
        for s in over:
            goal[s] = 3.0 * size[s]
        fixed |= over


def test_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(200):
        votes, seats = rng.integers(0, 50, rng.integers(1, 8)), int(rng.integers(0, 40))
        won = np.zeros(len(votes), int)
        for _ in range(seats if votes.sum() else 0):
            won[np.argmax(votes / (2 * won + 1))] += 1
        got = mixing.sainte_lague(votes, seats)
        assert got.sum() == won.sum()
        given = (votes / (2 * got - 1.0))[got > 0]
        assert not len(given) or given.min() >= (votes / (2 * got + 1)).max() - 1e-9


def check(rows, docs):
    size = defaultdict(int)
    for r in docs:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    goal, taken, n = brute_targets(size), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.passes * r.size + sum(x.end - x.start for x in r.ranges)
        assert all(0 <= x.start < x.end <= r.size for x in r.ranges)
        taken[r.source] += r.taken
        n[r.source] += 1
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 20 + 0.002 * goal[s], (s, taken[s], goal[s])


def test_mix_of_all_documents(spark, sf_dir):
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixing.mix(docs, mixing.n_words("text"), shard=2000)
    rows = out.collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    again = mixing.mix(docs.repartition(5), mixing.n_words("text"), shard=2000)
    assert rows_by_id(out.select("doc_id", "taken", F.to_json("ranges"))) == rows_by_id(again.select("doc_id", "taken", F.to_json("ranges")))


def test_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    rows = mixing.mix(docs, mixing.n_words("text")).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    assert mixing.mix(docs.limit(0), mixing.n_words("text")).count() == 0


def test_query(spark, sf_dir):
    out = QUERIES["op10_mixing"](spark, sf_dir)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert out.where("taken > 3 * size").count() == 0
