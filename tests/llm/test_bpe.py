import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cases import odd_documents
from peerlens.llm import bpe
from peerlens.llm.queries import QUERIES
from peerlens.session import ship_package


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken_on_random_text(reference):
    rng = random.Random(3)
    pool = "abcdefgh ETAON  \n\t'sll0123456789.,;!éñß漢字かな😀‍́ \u0085 <|endoftext|>"
    for _ in range(2000):
        spaces = rng.choice(["", " ", "   \n", "\u00a0 \u2003 \x1f\x85"])
        text = "".join(rng.choice(pool + spaces) for _ in range(rng.randrange(60)))
        assert bpe.tokenizer(bpe.VOCABULARY).encode(text, add_special_tokens=False).ids == reference.encode_ordinary(text), text
        assert np.frombuffer(bpe.packed_ids([text])[0], "<u4").tolist() == reference.encode_ordinary(text), text


def test_round_trip_and_offsets(spark):
    ship_package(spark)
    docs = odd_documents(spark)
    out = bpe.encode_documents(docs).withColumn("back", bpe.decode("ids")).withColumn("list", bpe.unpacked_ids("ids"))
    out = out.withColumn("tokens", bpe.encode_with_offsets("text"))
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert bytes(r.back).decode() == (r.text or "")
        assert [t.id for t in r.tokens] == r.list == np.frombuffer(bytes(r.ids), "<u4").tolist()
        if r.text and r.tokens:
            assert all(r.tokens[i].start <= r.tokens[i + 1].start for i in range(len(r.tokens) - 1))
            assert r.tokens[0].start == 0 and r.tokens[-1].end == len(r.text)
    emoji = next(r for r in rows if r.doc_id == 8)
    at = emoji.text.index("😀")
    assert sum(t.start <= at < t.end for t in emoji.tokens) > 1  # split over tokens, all with the character's place
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    assert docs.select(bpe.decode(F.lit(None).cast("binary")).alias("x")).where("x is null").count() == docs.count()


def test_query_equals_tiktoken(spark, sf_dir, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
