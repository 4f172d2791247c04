import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm.cases import odd_documents
from peerlens.llm import suffix_dedup as sd
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def brute(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(b), sum(covered), spans, bytes(x for x, c in zip(b, covered) if not c)))
    return out


def check(spark, texts, **shape):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs, **shape).collect()}
    want = brute(texts, shape["length"])
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i][:3], w[:3])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = say(90), say(130)
    out = ["", None, "short", "a" * 39, "a" * 40, "a" * 200, "ab" * 100, say(60) + passage + say(70), passage + say(10), say(5) + passage]
    out += [say(rng.randrange(60)) + other[rng.randrange(60) : rng.randrange(70, 130)] + say(rng.randrange(60)) for _ in range(60)]
    base = say(400)
    for _ in range(40):  # near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(400)] = rng.choice("xyz")
        out.append("".join(t))
    own = say(80)
    return out + [own + say(30) + own, own[:50] + own[10:60], base, base, "é" * 100 + say(3), "é" * 60]


def test_against_brute_force(spark, texts):
    ship_package(spark)
    check(spark, texts, length=40, gram=8)


def test_shards_merged_by_binary_search(spark, texts):
    ship_package(spark)
    check(spark, texts, length=40, gram=8, shard=400)


def test_pieces_of_long_texts(texts, monkeypatch):
    import pyarrow as pa

    arr = pa.array([(t or "") for t in texts])
    whole = sorted(zip(*[x.tolist() for x in sd.anchors(arr, 40, 8)]))
    monkeypatch.setattr(sd, "PIECE", 97)
    assert sorted(zip(*[x.tolist() for x in sd.anchors(arr, 40, 8)])) == whole


def test_every_string_has_its_anchor(texts):
    import pyarrow as pa

    raw = [(t or "").encode() for t in texts]
    row, place, key, *_ = sd.anchors(pa.array([(t or "") for t in texts]), 40, 8)
    have = {(r, p): k for r, p, k in zip(row.tolist(), place.tolist(), key.tolist())}
    of = {}
    for i, b in enumerate(raw):
        for k in range(len(b) - 39):
            found = {(p - k, have[i, p]) for p in range(k, k + 33) if (i, p) in have}
            assert found
            of[b[k : k + 40]] = of.get(b[k : k + 40], found) & found
    assert all(of.values())


def random_windows(seed, letters="ab"):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    return parts + parts[:2] + ["a" * 30, "a" * 35]


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_and_common_prefixes(seed):
    parts = random_windows(seed)
    text = np.frombuffer("".join(parts).encode(), np.uint8)
    windows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    ends = np.repeat(windows[1:], np.diff(windows))
    order, _ = sd.suffix_array(text, ends)
    suffix = lambda i: bytes(text[i : ends[i]])
    assert sorted(order.tolist()) == list(range(len(text)))
    named = [suffix(i) for i in order]
    assert named == sorted(named)
    shared = sd.common_prefixes(text, order, windows)
    for a, b in zip(order, order[1:]):
        x, y = suffix(a), suffix(b)
        assert shared[b] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert shared[order[0]] == 0


@pytest.mark.parametrize("seed", range(4))
def test_strings_of_shards_merge_to_what_one_shard_has(seed):
    import pyarrow as pa

    parts = [p * 3 for p in random_windows(seed, "abc") + random_windows(seed + 50, "abc")]
    rows = lambda which: pa.table({
        "key": [1] * len(which), "sub": [which[0] % 2] * len(which), "n": [1] * len(which), "did": list(which), "start": [0] * len(which),
        "data": pa.array([parts[i].encode() for i in which], pa.binary())})

    def marked(table):
        return {(d, p) for d, a, b in zip(*(table[c].to_pylist() for c in ("did", "start", "stop"))) for p in range(a, b)}

    halves = [sd._strings_of(9, 1)(rows(list(range(k, len(parts), 2)))) for k in (0, 1)]
    both = pa.concat_tables(halves)
    own, strings = both.filter(pa.compute.is_null(both["part"])), both.filter(pa.compute.is_valid(both["part"]))
    assert marked(own) | marked(sd._merged(9)(strings)) == marked(sd._in_shard(9)(rows(list(range(len(parts))))))


def test_every_document(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = brute([t for _, t in docs], 400)
    got = {r.doc_id: r for r in QUERIES["op9_suffix"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, _), (n, removed, spans, kept) in zip(docs, want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (n, removed, spans)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    rows = sd.remove_repeats(docs).collect()
    assert len(rows) == docs.count() and all(r.n_removed == 0 for r in rows if r.doc_id != 6)
    long = next(r for r in rows if r.doc_id == 6)
    assert 0 < long.n_removed < long.n_bytes  # it repeats itself after 30,287 words
    twice = sd.remove_repeats(docs.union(docs)).collect()
    assert len(twice) == 2 * len(rows) and all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in twice)
    assert sd.remove_repeats(docs.limit(0)).count() == 0
