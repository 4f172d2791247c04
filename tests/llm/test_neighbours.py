"""Nearest neighbours against comparing each query with all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import neighbours


def made(n, d=16, seed=0, centres=12, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    return (middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))).astype(np.float32)


def table(spark, rows, kind="float"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, score string")


def searched(spark, rows, **how):
    out = {}
    for r in neighbours.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, **how).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items() if [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))}


def sound(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows, k=10):
    out, known = {}, {}
    for i, v in rows:
        if i is not None and sound(v):
            known.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    for q, vs in known.items():
        if q % 100:
            continue
        x = min(vs, key=lambda v: v.astype(np.float32).tobytes())
        near = []
        for i, ws in known.items():
            ds = [math.sqrt(((x - w) ** 2).sum()) for w in ws if len(w) == len(x)]
            if i != q and ds:
                near.append((min(ds), i))
        out[q] = [(i, d) for d, i in sorted(near)[:k]]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def many():
    x = made(6000)
    return [(i, x[i]) for i in range(len(x))]


def test_recall_scores_and_order(spark, many):
    got, want = searched(spark, many), brute(many)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    x = dict(many)
    for q, found in got.items():
        for i, score in found:
            assert abs(score - math.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())) < 1e-12
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and q not in {i for i, _ in found}


def test_chunks_do_not_change_the_result(spark, many):
    assert searched(spark, many, most_rows=150, most_queries=3) == searched(spark, many)


def test_every_query_is_full_even_if_buckets_are_empty(spark):
    x = made(900, centres=300, spread=0.001, seed=4) * np.linspace(1, 9, 900)[:, None].astype(np.float32)
    rows = [(i, x[i]) for i in range(900)]
    got, want = searched(spark, rows, recall=0.05), brute(rows)
    assert all(len(got[q]) == 10 for q in want)


def test_ties_copies_and_odd_rows(spark):
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(350)]
    rest = [(1000 + i, [1.0 + i, 2.0, 3.0]) for i in range(1, 9)] + [(1001, [1.0 - 1, 2.0, 3.0]), (1100, [5.0, 2.0, 3.0])]
    odd = [
        (2000, None), (2100, []), (2200, [0.0, 0.0, 0.0]), (2300, [1.0, None, 2.0]), (2400, [float("nan"), 1.0, 1.0]), (2500, [float("inf"), 1.0, 1.0]),
        (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.1]), (2600, [1.0, 2.0]), (2601, [4.0, 6.0]), (2700, [1.0]), (0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    rows = copies + rest + odd
    got, want = searched(spark, rows), brute(rows)
    assert {q: v for q, v in want.items() if v} == got
    assert [i for i, _ in got[0]] == list(range(1, 11)) and got[2600] == [(2601, 5.0)] and 2700 not in got
    assert searched(spark, []) == {} and searched(spark, [(1, [1.0])]) == {} and searched(spark, [(100, [1.0])]) == {}


def test_visits_come_in_order_of_success():
    rng = np.random.default_rng(1)
    index = neighbours.Index(rng.normal(size=(2, 5, 8)), rng.uniform(size=(2, 5)), 0.6, 2, 3**5)
    x = rng.normal(size=(3, 8))
    groups, buckets = index.visits(x, 1)
    at = index.places(x, 1)
    cells = np.floor(at).astype(int)
    normal = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for q in range(3):
        steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * 5, indexing="ij"), -1).reshape(-1, 5)
        chance = [math.prod(normal((s + 1 - w) / 0.6) - normal((s - w) / 0.6) for s, w in zip(step, at[q] - cells[q])) for step in steps.tolist()]
        group, bucket = index.named(cells[q] + steps, 1)
        chances = dict(zip(bucket.tolist(), chance))
        seen = [chances[b] for b in buckets[q].tolist()]
        assert len(set(buckets[q].tolist())) == 3**5 and all(a >= b - 1e-6 for a, b in zip(seen, seen[1:]))
        assert dict(zip(bucket.tolist(), group.tolist())) == dict(zip(buckets[q].tolist(), groups[q].tolist()))
        few = neighbours.Index(index.lines, index.shifts, 0.6, 2, 20).visits(x, 1)[1][q]
        assert np.allclose([chances[b] for b in few.tolist()], seen[:20])
