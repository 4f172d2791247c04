import math
import zlib

import numpy as np
import pytest

from llm.cases import odd_documents
from peerlens.llm import quality
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def test_scores_equal_two_gaussian_densities():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    means = [rng.normal(size=d), rng.normal(size=d)]
    covs = [(lambda a: a @ a.T + np.eye(d))(rng.normal(size=(d, d))) for _ in (0, 1)]
    model = quality.Discriminant(0.7, means, [np.linalg.cholesky(c) for c in covs])
    x = rng.normal(size=(20, d)) * 2

    def density(k, v):
        z = v - means[k]
        return -0.5 * z @ np.linalg.inv(covs[k]) @ z - 0.5 * np.linalg.slogdet(covs[k])[1] + math.log(0.7 if k else 0.3)

    want = [1 / (1 + math.exp(max(-700, min(700, density(0, v) - density(1, v))))) for v in x]
    assert np.allclose(model.score(x), want)


def test_fit_equals_numpy(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x, y = rng.normal(size=(300, d)), rng.integers(0, 2, 300)
    rows = [(v.tolist(), int(k)) for v, k in zip(x, y)] + [(x[0].tolist(), None)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int"), shrink=0.2, ridge=0.1)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = y.mean()
    pooled = (1 - share) * own[0] + share * own[1]
    target = 0.9 * pooled + 0.1 * np.trace(pooled) / d * np.eye(d)
    for k in (0, 1):
        assert np.allclose(model.means[k], x[y == k].mean(0))
        assert np.allclose(model.factors[k] @ model.factors[k].T, 0.8 * own[k] + 0.2 * target + 1e-6 * np.eye(d))


def test_odd_documents_and_missing_labels(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    stats = docs.select("doc_id", "score", quality.statistics("text").alias("x"))
    none = quality.train(stats, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.train(stats, spark.createDataFrame([(1, 1), (3, 1), (4, None), (None, 0)], "doc_id long, quality int"))
    both = quality.train(stats, spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int"))
    for model, only in ((none, 0.5), (one, 1.0), (both, None)):
        got = [r.s for r in stats.select(quality.scored(model, "x").alias("s")).collect()]
        assert len(got) == docs.count() and all(0 <= s <= 1 for s in got)
        assert only is None or set(got) == {only}
    assert stats.limit(0).select(quality.scored(both, "x").alias("s")).count() == 0
    same = {tuple(r.x) for r in stats.where("doc_id in (3, 4, 9)").collect()}
    assert len(same) == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


@pytest.mark.parametrize("text", ["", "One fine line.", "A\nA\nB b b"])
def test_statistics_by_hand(text):
    import pyarrow as pa

    x = dict(zip(quality.STATISTICS, quality._statistics(pa.array([text]))[0]))
    words, lines = text.lower().split(), [ln for ln in text.lower().split("\n") if ln]
    assert math.isclose(x["length"], math.log1p(len(text)))
    assert math.isclose(x["repeated"], math.log((len(words) - len(set(words)) + 0.5) / (len(words) + 1)))
    assert math.isclose(x["adjacent"], math.log((sum(a == b for a, b in zip(words, words[1:])) + 0.5) / (len(words) + 1)))
    assert math.isclose(x["lines_again"], math.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 1)))
    assert math.isclose(x["upper"], math.log((sum(c.isupper() for c in text) + 0.5) / (sum(c.isalpha() for c in text) + 1)))
