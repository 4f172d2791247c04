import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from llm.cases import odd_documents
from peerlens.llm import arrow_text, fingerprints
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


def bag(text):
    return Counter(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()))


def alike(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def check(rows, docs):
    docs = sorted(docs, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    want = {}
    for i, r in enumerate(docs):
        own, after = r.text or "", docs[(i + 1) % len(docs)].text or ""
        n = len(own)
        want.setdefault(r.doc_id, []).append((n, hashlib.sha256((own[: n - n // 4] + after[: n // 4]).encode()).hexdigest(), own, after))
    assert len(rows) == len(docs)
    error = []
    for r in rows:
        got = next(w for w in want[r.doc_id] if w[:2] == (r.n_chars, r.edited_sha256))
        want[r.doc_id].remove(got)
        n, _, own, after = got
        error += [r.near_edited - alike(own, own[: n - n // 4] + after[: n // 4]), r.near_next - alike(own, after)] if bag(own) else []
        assert not bag(own) or not bag(after) or r.near_next < 1 or r.fingerprint
        assert bag(own) or set(r.fingerprint) == {"0"}
    return error


def test_words_equal_the_pattern():
    texts = ["", "a", " a\tB\x0bc ", None, "É é", "x" * 5000, "   ", "The the THE", "y " * 3000]
    keep = arrow_text.SEGMENT
    try:
        for arrow_text.SEGMENT in (keep, 64):
            hashes, rows = arrow_text.words(*arrow_text.utf8(pa.array(texts)))
            want = [(w, i) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
            assert rows.tolist() == [i for _, i in want]
            names = {}
            assert all(names.setdefault(w, h) == h for (w, _), h in zip(want, hashes.tolist()))
            assert len(set(names.values())) == len(names)
    finally:
        arrow_text.SEGMENT = keep


def test_collision_rate_is_generalised_jaccard():
    texts = ["a a a b c d", "a b c d d d", "a a a b c d", "x y z", "", None, "   "]
    s = fingerprints.signatures(pa.array(texts), 4096)
    for i in range(4):
        for j in range(4):
            assert abs(fingerprints.likeness(s[i : i + 1], s[j : j + 1])[0] - alike(texts[i], texts[j])) < 0.035
    assert (s[4:] == 0).all()


def test_every_document_and_its_edit(spark, sf_dir):
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    error = check(QUERIES["op8_fingerprints"](spark, sf_dir).collect(), docs.collect())
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08


def test_odd_documents(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    check(fingerprints.compare_edits(docs).collect(), docs.collect())
    check(fingerprints.compare_edits(docs.where("doc_id is null")).collect(), docs.where("doc_id is null").collect())
    assert fingerprints.compare_edits(docs.limit(0)).count() == 0
    prints = {r.text: r.fingerprint for r in fingerprints.with_fingerprints(docs).collect()}
    assert len({v for k, v in prints.items() if k == "one two"}) == 1 and set(prints[None]) == {"0"}
