"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import cases
import pytest

from peerlens.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) != len(a) + 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return b[k + 1 :] == a[k:]


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def changed(word, rng):
    k, letter = rng.randrange(len(word)), rng.choice("abeinorstuzéÉ÷")
    return rng.choice([word[:k] + letter + word[k:], word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :]])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    letters = "eeeeaaaiinnoorrssttuldzé"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 7, 8, 9, 12, 30]))) for _ in range(90)]
    base += ["e" * 20, "e" * 21, "e" * 19 + "ee" + "z", "Entertaining", "entertaininG", "z" * 7, "z" * 8, "z" * 9]
    words = []
    for w in base:
        once = [changed(w, rng) for _ in range(4)]
        twice = [changed(x, rng) for x in once if x]
        often = rng.choice([(1, 1, 1), (30, 2, 1), (250, 3, 2), (260, 22, 2)])
        words += [w] * often[0] + once * often[1] + twice * often[2]
    rng.shuffle(words)
    seps = [" ", ", ", "\n", "-", "3", "Ā"]
    rows = []
    for k in range(0, len(words), 37):
        rows.append((k if k % 5 else None, "".join(w + rng.choice(seps) for w in words[k : k + 37])))
    return rows


def ran(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    return sorted(map(tuple, spelling.spelling_variants(docs, **how).collect()))


@pytest.mark.parametrize("node", [spelling.NODE, 2000, 1])
def test_equals_comparing_all_words(spark, made, node):
    got = ran(spark, made, node=node)
    assert len(got) == len(set(got)) and set(got) == brute(made)
    assert any(r[1] for r in got) and any(r[2] != r[1] and r[1] for r in got) and max(r[4] for r in got) > 3


def test_small_leaves_find_the_same(spark, made):
    words = sorted(counted(made).items())
    by_length = {}
    for w, _ in words:
        by_length.setdefault(len(w), []).append(w)
    want = {frozenset(p) for p in ((a, b) for a, _ in words for b, _ in words if a < b and one_apart(a, b))}
    got, leaf = [], spelling.LEAF
    spelling.LEAF = 1
    try:
        for length, home in by_length.items():
            guests = by_length.get(length + 1, [])
            states = [spelling.HOME] * len(home) + [spelling.LONG] * len(guests)
            names = home + guests
            pairs = spelling._Node(length, home, guests, 0).search(spelling.np.array(states))
            got += [frozenset((names[a], names[b])) for a, b in pairs.tolist()]
    finally:
        spelling.LEAF = leaf
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_documents(spark):
    docs = cases.odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = "abcdefg" * 200_000
    rows += [(77, f"{long} {long}x {long} {long}x"), (78, "abcdefgh " * 40 + "abcdefgx abcdefgx")]
    got = ran(spark, rows)
    assert set(got) == brute(rows) and any(len(r[0]) > 1_000_000 and r[4] == 1 for r in got)
    assert ran(spark, []) == [] and ran(spark, [(1, None), (2, "")]) == []


def test_names_of_runs():
    names = [b"17:", b":", b"-3:"]
    table = spelling._named(names, 9)
    for k, name in enumerate(names):
        for word in (b"", b"a", b"entering"):
            assert int(table[len(word), k]) ^ zlib.crc32(word) == zlib.crc32(name + word)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(18)] + [("x", "w3")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert set(got.values()) == {"w18"} and len(got) == 19
