"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur. For sample k and term x with weight w, r and c are Gamma(2, 1) and
b is uniform, all made from a hash of (x, k); then t = floor(ln w / r + b), ln y = r (t - b), a = c / (y e^r). The term
with the least a is the sample, kept as 16 bits of a hash of (x, t, k). Two texts agree in a sample with probability
sum min(w, w') / sum max(w, w'), their generalised Jaccard similarity, so the share of equal samples estimates it.

A text without words (null, empty, white space) has the fingerprint of zeros: two of them are alike 1, one of them and
another text 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import by_bytes, mixed, utf8, words

SAMPLES = 64
_BLOCK = 1 << 15  # terms, or terms of documents, worked on at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniforms(seed: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each seed."""
    h = mixed(seed + np.uint64((salt * int(_STEP)) % (1 << 64)))
    scale = np.float32(2.0**-24)
    low = ((h & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
    return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, low


def _keys(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """terms x samples: the order of ln a in the high 32 bits, a hash of (term, t, sample) in the low ones."""
    out = np.empty((len(terms), samples), np.uint64)
    ks = mixed(np.arange(1, samples + 1, dtype=np.uint64) * _STEP)
    for at in range(0, len(terms), _BLOCK // 8):
        seed = terms[at : at + _BLOCK // 8, None] ^ ks
        u1, u2 = _uniforms(seed, 1)
        u3, u4 = _uniforms(seed, 2)
        b, _ = _uniforms(seed, 3)
        r = -np.log(u1 * u2)
        t = np.floor(np.log(weights[at : at + _BLOCK // 8, None].astype(np.float32)) / r + b)
        lna = np.log(-np.log(u3 * u4)) - r * (t - b + np.float32(1))
        bits = lna.astype(np.float32).view(np.uint32)
        order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        name = mixed(seed + t.astype(np.int64).astype(np.uint64) * _STEP) >> np.uint64(32)
        out[at : at + _BLOCK // 8] = (order << np.uint64(32)) | name
    return out


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """texts x samples, 16 bits each."""
    out = np.zeros((len(texts), samples), np.uint16)
    hashes, rows = words(*utf8(texts))
    if not len(hashes):
        return out
    names, code = np.unique(hashes, return_inverse=True)
    pairs, weights = np.unique(rows * len(names) + code, return_counts=True)
    row, code = np.divmod(pairs, len(names))
    kinds, kind = np.unique((code << 32) | weights, return_inverse=True)  # equal term and weight: equal key
    keys = _keys(names[kinds >> 32], kinds & 0xFFFFFFFF, samples)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.append(starts[1:], len(row))
    at = 0
    while at < len(starts):  # whole documents, about _BLOCK terms at a time
        stop = max(int(np.searchsorted(ends, starts[at] + _BLOCK, "right")), at + 1)
        low = starts[at]
        if ends[stop - 1] - low > 2 * _BLOCK:  # one long document, in parts
            least = np.full(samples, ~np.uint64(0))
            for p in range(low, ends[at], _BLOCK):
                least = np.minimum(least, keys[kind[p : min(p + _BLOCK, ends[at])]].min(0))
            least = least[None]
        else:
            least = np.minimum.reduceat(keys[kind[low : ends[stop - 1]]], starts[at:stop] - low, axis=0)
        out[row[starts[at:stop]]] = (least & np.uint64(0xFFFF)).astype(np.uint16)
        at = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples of each pair of rows."""
    return (a == b).mean(1)


def shown(signature: np.ndarray) -> list[str]:
    """Four hexadecimal digits per sample."""
    return [row.astype(">u2").tobytes().hex() for row in signature]


@F.arrow_udf(T.StringType())
def fingerprint(text: pa.Array) -> pa.Array:
    """The fingerprint of each text."""
    return pa.array([x for a, b in by_bytes(text, 1 << 21) for x in shown(signatures(text[a:b]))], pa.string())


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows with a fingerprint of `text`. Other columns pass through unchanged."""
    return df.withColumn(out, fingerprint(F.col(text)))


def in_order(docs: DataFrame, partitions: int) -> tuple[DataFrame, int]:
    """bucket, guest, doc_id, text: the rows dealt to runs of ascending ids, null ids last, equal ids by text.

    Each run also gets the first row of the next one as a guest, the last run the first of all. The bounds are ids near
    the quantiles, so runs have about equal numbers of rows; no more bounds than partitions reach the driver.
    """
    cuts = [i / partitions for i in range(1, partitions)] or [0.5]
    marks = docs.agg(F.percentile_approx("doc_id", cuts, 100 * partitions).alias("cuts"), F.min("doc_id").alias("least")).first()
    bounds = np.array(sorted({*(marks.cuts or ())} - {marks.least}), np.int64) if partitions > 1 else np.zeros(0, np.int64)
    last = len(bounds)

    @F.arrow_udf("array<int>")
    def runs(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        value = ids.fill_null(0).to_numpy()
        at = np.where(known, np.searchsorted(bounds, value, "right"), last)
        lists = [[int(x)] for x in at]
        for i in np.flatnonzero(known & np.isin(value, bounds)):
            lists[i].append(int(at[i]) - 1)
        if marks.least is not None:
            for i in np.flatnonzero(known & (value == marks.least)):
                lists[i].append(last)
        return pa.array(lists, pa.list_(pa.int32()))

    dealt = docs.select(F.posexplode(runs("doc_id")).alias("guest", "bucket"), "doc_id", "text")
    return dealt, last + 1


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; likeness to the next document by id.

    Edited: the last floor(n / 4) of n code points replaced by the first as many (or all) of the next text, the first
    document being next to the last. A run of ids is streamed in order, one row held back, so memory does not grow with it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt, runs = in_order(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(runs, "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_last("doc_id"), "text")

    def compare(batches):
        held = None  # last row so far, its next one still to come: (bucket, guest, doc_id, text, signature)
        first = None  # first row of the bucket, next of the last one where no guest came
        for batch in batches:
            for a, b in by_bytes(batch["text"], 1 << 20):
                part = batch.slice(a, b - a)
                own = [t or "" for t in part["text"].to_pylist()]
                sigs = signatures(pa.array(own, pa.large_string()), samples)
                fresh = list(zip(part["bucket"].to_pylist(), part["guest"].to_pylist(), part["doc_id"].to_pylist(), own, sigs))
                out = []
                for row in fresh:
                    if held is not None:
                        out.append((held, row if row[0] == held[0] else first))
                    if held is None or row[0] != held[0]:
                        first = row
                    held = row
                yield from described([x for x in out if not x[0][1]])
        if held is not None and not held[1]:
            yield from described([(held, first)])

    def described(pairs):
        if not pairs:
            return
        edited = []
        for row, after in pairs:
            n = len(row[3])
            edited.append(row[3][: n - n // 4] + after[3][: n // 4])
        own, following = np.stack([p[0][4] for p in pairs]), np.stack([p[1][4] for p in pairs])
        changed = signatures(pa.array(edited, pa.large_string()), samples)
        yield pa.RecordBatch.from_arrays([
            pa.array([p[0][2] for p in pairs], pa.int64()), pa.array([len(p[0][3]) for p in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(shown(own)), pa.array(shown(changed)),
            pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(compare, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))
