import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm.cases import odd_documents
from peerlens.llm import jaccard_join as jj
from peerlens.llm.components import components
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """(size, smallest index reachable) of each text, by all pairs that share a shingle."""
    sets, inverted, parent = [shingles(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in inverted[x])
        for j, k in both.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            inverted[x].append(i)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def check(spark, texts, **shape):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(docs, **shape).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == want


def near_copies(rng, words, n, edits):
    base, out = [f"v{rng.randrange(10**6)}" for _ in range(words)], []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(4)
    texts = []
    for words, n, edits in ((200, 60, 5), (80, 40, 3), (40, 30, 1), (13, 40, 1), (9, 30, 1), (400, 5, 12)):
        texts += near_copies(rng, words, n, edits)
    for size in range(1, 30):  # short texts that differ by a word at an end
        base = [f"s{size}w{i}" for i in range(size)]
        texts += [" ".join(base), " ".join(base + ["x"]), " ".join(base[1:]), " ".join(base + ["y", "z"])]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} own{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" for i in range(40)]
    texts += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(50)) + " " + passage for _ in range(20)]
    return texts + texts[:7] * 20 + ["", None, " \n", "one", "One", "one two"]


def test_all_kinds_against_brute_force(spark, mixed_texts):
    ship_package(spark)
    check(spark, mixed_texts)


def test_large_groups_are_split_without_loss(spark, mixed_texts):
    ship_package(spark)
    check(spark, mixed_texts, group=2000)


def test_frequent_shingles_and_small_batches(spark, mixed_texts, monkeypatch):
    texts = [t or "" for t in mixed_texts]
    sets = {}
    for own in jj.shingle_sets(pa.array(texts)):
        if len(own):
            sets[jj.class_of(own)] = own
    monkeypatch.setattr(jj, "BATCH", 500)
    blocks = pa.Table.from_batches(list(jj._blocks(3)(iter([pa.record_batch({"text": texts})]))))
    count, found = Counter(x for s in sets.values() for x in s.tolist()), defaultdict(dict)
    for b in set(blocks["bucket"].to_pylist()):
        part = blocks.filter(pa.compute.equal(blocks["bucket"], b))
        for i in range(len(part)) if b < 0 else [None]:
            for r in jj._shared(2)(part if i is None else part.slice(i, 1)).to_pylist():
                names, counts = np.frombuffer(r["cls"], "<i8"), np.frombuffer(r["counts"], "<u4")
                keys, rarity = np.frombuffer(r["keys"], "<u8").tolist(), np.frombuffer(r["rarity"], "<u2").tolist()
                for name, k, rare in zip(np.repeat(names, counts).tolist(), keys, rarity):
                    assert found[name].setdefault(k, rare) == rare
    rank = {}
    for name, own in sets.items():
        assert len(found[name]) == sum(count[x] > 1 for x in own.tolist())
        for k, rare in found[name].items():
            assert rank.setdefault(k, rare) == rare  # the same order for every class


def test_subset_sizes_and_prefixes():
    for s in range(1, 40):
        for t in range(s, 60):
            need = next((o for o in range(s + 1) if 100 * o >= 80 * (s + t - o)), None)
            if need is not None:
                assert jj.overlap(s, t) == need and need in jj.subset_sizes(s) and need in jj.subset_sizes(t)
                assert need >= s - jj.prefix_length(s) + 1 and need >= t - jj.prefix_length(t) + 1


def test_boundary_follows_the_sizes():
    assert jj.boundary({4: 10, 500: 10}) >= 4
    assert jj.boundary({}) == 0
    assert 0 < jj.boundary({s: 100 for s in range(1, 65)}) < 24


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2030)]
    parent = {x: x for p in pairs for x in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "t").collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_every_document(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = brute([t for _, t in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard"](spark, sf_dir).collect()}
    assert got == {i: (n, docs[c][0]) for (i, _), (n, c) in zip(docs, want)}


def test_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join_components(docs).collect()), key=str)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == docs.count()
    assert by_id[0] == (0, 0, 0) and by_id[1] == (1, 0, 1) and by_id[2] == (2, 0, 2)
    assert by_id[3] == (3, 1, 3) and by_id[4] == (4, 1, 3) and rows.count((9, 1, 3)) == 2
    assert by_id[None] == (None, 1, None)
    assert jj.join_components(docs.limit(0)).count() == 0
