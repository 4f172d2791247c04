"""Quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (log ratios of counts). Class means and covariances come from sums
over all labelled rows, one row per class reaching the driver. A class covariance is shrunk towards the pooled one and
towards a multiple of the identity; its Cholesky factor is kept, and a score is the posterior of the difference of the
two Mahalanobis log densities. Only the text enters a score.

A null text is an empty one: its statistics are those of no words, and it gets a score like any other. Rows without a
label, or whose label is null, do not train; repeated labels each count. With no row of one class the score of every
document is the share of label 1 (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import NEWLINE, by_bytes, list_array, utf8, words

_MARKS = b"#$%&*|@~^_=+<>{}[]\\/"
_KINDS = ("letter", "upper", "digit", "stop", "shout", "mark", "line", "pause")
STATISTICS = (
    "length", "word_length", "upper", "digit", "stop", "shout", "mark", "line", "pause", "repeated", "adjacent", "top", "lines_again")


def _kinds() -> np.ndarray:
    """Kinds x 256: which bytes count for which kind. Lead bytes stand for letters beyond ASCII."""
    out = np.zeros((len(_KINDS), 256), bool)
    out[0, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF0)]] = True
    out[1, 0x41:0x5B] = True
    out[2, 0x30:0x3A] = True
    out[3, list(b".")] = True
    out[4, list(b"!?")] = True
    out[5, list(_MARKS)] = True
    out[6, 0x0A] = True
    out[7, list(b",;:")] = True
    return out


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of items that repeat an earlier one, count of the most frequent item) of each row."""
    again, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(hashes):
        key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(first)
        row = (key[start] >> np.uint64(40)).astype(np.int64)
        runs = np.diff(np.append(start, len(key)))
        again = np.bincount(rows, minlength=n) - np.bincount(row, minlength=n)
        np.maximum.at(top, row, runs)
    return again, top


def _statistics(texts: pa.Array) -> np.ndarray:
    raw, offsets = utf8(texts)
    n = len(texts)
    counts = {k: _per_row(table[raw], offsets) for k, table in zip(_KINDS, _kinds())}
    accented = np.zeros(len(raw), bool)  # capitals from U+00C0 to U+00DE
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    counts["upper"] = counts["upper"] + _per_row(accented, offsets)
    hashes, rows = words(raw, offsets)
    n_words = np.bincount(rows, minlength=n)
    again, top = _repeats(hashes, rows, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    adjacent = np.bincount(rows[same], minlength=n)
    lines, line_rows = words(raw, offsets, NEWLINE)
    n_lines = np.bincount(line_rows, minlength=n)
    lines_again, _ = _repeats(lines, line_rows, n)
    size = np.diff(offsets)

    def ratio(x, of):
        return np.log((x + 0.5) / (of + 1.0))

    return np.stack([
        np.log1p(size), np.log((size + 5.0) / (n_words + 1.0)), ratio(counts["upper"], counts["letter"]),
        ratio(counts["digit"], n_words), ratio(counts["stop"], n_words), ratio(counts["shout"], n_words),
        ratio(counts["mark"], n_words), ratio(counts["line"], n_words), ratio(counts["pause"], n_words), ratio(again, n_words),
        ratio(adjacent, n_words), ratio(top, n_words), ratio(lines_again, n_lines)], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(text: pa.Array) -> pa.Array:
    """The transformed statistics of each text, in the order of STATISTICS."""
    parts = [_statistics(text[a:b]) for a, b in by_bytes(text)]
    flat = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return list_array(pa.array(flat.reshape(-1)), np.full(len(flat), len(STATISTICS)))


@dataclass
class Discriminant:
    """Means, lower Cholesky factors of the covariances and log priors of classes 0 and 1; share: of label 1."""

    share: float
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        logs = []
        for k, (mean, factor) in enumerate(zip(self.means, self.factors)):
            z = np.linalg.solve(factor, (x - mean).T)
            prior = np.log(self.share if k else 1 - self.share)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02, x: str = "x", label: str = "label") -> Discriminant:
    """A discriminant from rows of statistics `x` and `label` 0 or 1.

    Covariance of a class: (1 - shrink) of its own + shrink of the pooled one, of which a share `ridge` is the mean
    variance times the identity.
    """
    d = len(STATISTICS)
    item = [F.col(x)[i] for i in range(d)]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(a) for a in item]).alias("s"),
        F.array(*[F.sum(item[i] * item[j]) for i in range(d) for j in range(i, d)]).alias("ss")).collect()
    got = {r.k: r for r in rows}
    total = sum(r.n for r in rows)
    share = got[1].n / total if 1 in got else 0.0 if total else 0.5
    if len(got) < 2:
        return Discriminant(share, [], [])
    means, scatters = [], []
    upper = np.triu_indices(d)
    for k in (0, 1):
        mean = np.array(got[k].s) / got[k].n
        second = np.zeros((d, d))
        second[upper] = got[k].ss
        second = second + second.T - np.diag(np.diag(second))
        means.append(mean)
        scatters.append(second / got[k].n - np.outer(mean, mean))
    pooled = (1 - share) * scatters[0] + share * scatters[1]
    spread = max(np.trace(pooled) / d, 1e-6)
    target = (1 - ridge) * pooled + ridge * spread * np.eye(d)
    factors = [np.linalg.cholesky((1 - shrink) * s + shrink * target + 1e-6 * np.eye(d)) for s in scatters]
    return Discriminant(share, means, factors)


def scored(model: Discriminant, x: Column | str) -> Column:
    """Posterior of label 1 for each vector of statistics."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        rows = x.values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if len(x) else np.zeros((0, len(STATISTICS)))
        return pa.array(model.score(rows))

    return score(x)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo `folds`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", **shape) -> Discriminant:
    """Fits on the labelled rows of `stats` (doc_id, x) that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
    rows = stats.where(~held_out(F.col(doc_id))).join(known, F.col(doc_id) == F.col("id")).select("x", "label")
    return fit(rows, **shape)
