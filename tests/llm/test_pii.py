import hashlib
import re

from pyspark.sql import functions as F

from llm.cases import LONG, odd_documents
from peerlens.llm import pii
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


TEXTS = [
    None, "", "a@b.c@d.ef x@y", "..@..a.b.", "me+you%1@ex-a.mple.org. and A@B", "1.2.3.4.5.6.7.8 256.1.1.1.9.9.9 0001.2.3.255",
    "4111 1111 1111 1111-5500-0000-0000-0004", "4111111111111111.2.3.4", "+1 (212) 555-0100, +1 212 +44 20 7946 0958).", "++1--2 +1(((",
    "+123456789012345678", "4242-4242 4242 4242 7", "é@é.com ü4111111111111111", "token = \"0123456789abcdef\" http://a.b/c?d=e",
    "IBAN: DE89 3704 0044 0532 0130 00 and DE00 3704 0044 0532 0130 00", "@" * 300, "1" * 5000, "1.1" * 2000, LONG]


def test_base_spans_equal_the_patterns():
    for text in TEXTS:
        assert [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == brute(text), text and text[:60]


def test_random_texts_equal_the_patterns():
    import random

    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789..  --@@++()ab%_é\n") for _ in range(rng.randrange(80)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == brute(text), text


def test_added_kinds_and_redaction():
    text = 'write to a.b@c.de, token = "0123456789abcdef0123", see https://a.b/c?d=e now, IBAN DE89 3704 0044 0532 0130 00.'
    kinds = {k for k, _, _ in pii.spans(text)}
    assert kinds == {"email", "secret", "url", "iban"}
    assert pii.redacted(text, pii.spans(text)) == 'write to [EMAIL], token = "[SECRET]", see [URL] now, IBAN [IBAN].'
    assert pii.redacted(None, []) is None
    assert pii.spans("The quick brown fox, 12 of 30 tokens in a secret place.") == []


def test_odd_documents_and_digests(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    found = pii.find_pii(docs)
    assert found.columns == [*docs.columns, "pii"] and found.count() == docs.count()
    assert {r.doc_id for r in found.where(F.size("pii") > 0).collect()} == set()
    assert pii.redact_pii(docs).where("text is null").count() == 1
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in BASE)
