"""Phrase collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from peerlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    return f


def brute(rows, often=10, covered=50, top=2000):
    out = []
    for lang, f in phrases(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found, long = [], {p: c for p, c in f.items() if len(p) == 3 and c >= often}
        for p, a in f.items():
            if len(p) == 1 or a < often:
                continue
            if len(p) == 2 and any(100 * c >= covered * a for q, c in long.items() if p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    common = ["the", "of", "New", "new", "york", "york's", "é", "日本", "x y", "a-b", "\x01"]
    fixed = ["in order to", "New York City", "of the", "per se", "a b c d"]
    rows = []
    for k in range(240):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(common))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! "]))
        rows.append((rng.choice(["en", "en", "en", "fr", "", None, "und"]), "".join(parts)))
    return rows


def ran(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int")
    return sorted(map(tuple, collocations.collocations(docs, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"window": 400, "part": 900}, {"window": 1 << 20, "part": 64}, {"top": 7}])
def test_equals_counting(spark, made, how):
    want = brute(made, **{k: v for k, v in how.items() if k == "top"})
    assert ran(spark, made, **how) == want
    assert {r[0] for r in want} == {"en", "fr", "", "und"} and {r[2].count(" ") for r in want} == {1, 2}


def test_long_pieces_are_cut_without_loss(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "b", "c" * 30, "dd"]) for _ in range(9000))
    rows = [("en", text), ("en", "z" * 5000 + " aa b " + "z" * 5000), ("fr", f"  {text[:4000]}  ")]
    assert ran(spark, rows, window=700, part=5000) == brute(rows)
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = [(s, e, t) for s, e, t in collocations.stretches(raw, 500)]
    assert len(seen) > 50 and all(t == 2 for _, _, t in seen[1:]) and seen[-1][1] == len(raw)


def test_odd_documents(spark):
    docs = cases.odd_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()] + [("en", "one two three " * 30_000), (None, "y" * 2_000_000)]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, []) == [] and ran(spark, [("en", None), (None, "")]) == []


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12 + 1, 4 * 10**12 + 3, 5 * 10**12 + 7)], "a long, l long, r long")
    a, left, right = row.first()
    assert row.select(collocations._scored("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)
