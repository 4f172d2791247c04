import numpy as np
import pytest
from pyspark.sql import types as T

from peerlens.llm import embedding_join as ej
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def brute(rows, like=0.93):
    """{index: (links, smallest id reachable)} by all pairs of a label."""
    sound = []
    for v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, float)
        ok = x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        sound.append(x / np.sqrt((x * x).sum()) if ok else None)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sound):
        for j in range(i):
            y = sound[j]
            if x is not None and y is not None and rows[i][1] == rows[j][1] and len(x) == len(y) and x @ y >= like:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (links[i], root(i)) for i in range(len(rows))}


def check(spark, rows, kind="array<float>", **shape):
    schema = f"vec_id long, embedding {kind}, label int, cls string, m int"
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, (v, label) in enumerate(rows)], schema).repartition(3)
    got = {r.vec_id: r for r in ej.near_duplicates(frame, **shape).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        base = rng.normal(size=16)
        for _ in range(25):
            rows.append(((base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), k % 3))
    rows += [(rng.normal(size=16).astype(np.float32).tolist(), 1) for _ in range(150)]
    rows += [(list(rows[0][0]), 0)] * 40 + [(list(rows[0][0]), 1), ([2 * c for c in rows[0][0]], 0)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(b, 1) for b in bad] + [(rows[0][0], None), ([1.0, 2.0], 1), ([1.0, 2.1], 1), ([1e30] * 16, 2), ([1e-30] * 16, 2)]
    return rows


def test_against_all_pairs(spark, vectors):
    ship_package(spark)
    check(spark, vectors)


def test_grids_and_chunks(spark, vectors):
    ship_package(spark)
    check(spark, vectors, cell=20, chunk=60, blocks=4)


def test_cells_of_seven_and_eight_dimensions(spark):
    """Vectors of 16 components in two blocks of 8, so that the grid of a label takes 7 and 8 dimensions."""
    ship_package(spark)
    rng = np.random.default_rng(6)
    bases = rng.normal(size=(6, 16))
    rows = [((bases[k % 6] + rng.normal(size=16) * 0.2).astype(np.float32).tolist(), 1) for k in range(60)]
    for grid in (7, 8):
        check(spark, rows, blocks=2, cell=60 / 2.5 ** (grid - 0.5))


def test_a_class_lies_in_a_cell_once():
    home, near = np.zeros((3, 8), np.int64), np.ones((3, 8), np.int64)
    names = ej._names(home, near)
    assert len(np.unique(names)) == 256 and ej._first_of_equal(names).all()
    names[1, 5] = names[1, 0]
    once = ej._first_of_equal(names)
    assert once[1, 0] and not once[1, 5] and once.sum() == 3 * 256 - 1


def test_double_components(spark, vectors):
    ship_package(spark)
    check(spark, [(v, k) for v, k in vectors[:80]], kind="array<double>")


def test_pigeonhole_blocks():
    rng = np.random.default_rng(0)
    q = ej.rotation(20)
    assert np.allclose(q @ q.T, np.eye(20))
    bounds = ej.cuts(20)
    shares = (2 - 2 * 0.93) * np.diff(bounds) / 20
    for _ in range(500):
        x = rng.normal(size=20)
        y = x + rng.normal(size=20) * 0.25
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        gaps = np.add.reduceat(((x - y) @ q) ** 2, bounds[:-1])
        assert x @ y < 0.93 or (gaps <= shares + 1e-12).any()


def test_odd_rows(spark):
    ship_package(spark)
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer")
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, None, 1), (None, [0.0, 1.0], 2)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ej.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (None, 0, None, False)], key=str)
    assert ej.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_every_vector(spark):
    sf = "/root/testdata/sf0.01"
    table = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    want = brute([(r.embedding, r.label) for r in table])
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op2_embeddings"](spark, sf).collect()}
    assert got == {table[i].vec_id: (n, table[c].vec_id) for i, (n, c) in want.items()}
