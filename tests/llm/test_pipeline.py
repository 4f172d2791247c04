import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from llm.cases import odd_documents
from llm.test_jaccard_join import brute
from llm.test_mixing import brute_targets
from llm.test_pii import brute as brute_spans
from peerlens.llm import bpe, pii, quality
from peerlens.session import ship_package, written_table


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage and the result of the last, over all documents of sf0.001."""
    ship_package(spark)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = written_table(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return sf, out


def test_names_and_columns(stages):
    _, out = stages
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    assert all(d.columns == cp.COLUMNS for d in out[:5]) and cp.ORACLE_SQL is None


def test_quality_keeps_clean_documents(spark, stages):
    sf, out = stages
    kept = {r.doc_id for r in out[1].collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in truth.items()]) > 0.95
    stats = out[0].select("doc_id", quality.statistics("text").alias("x"))
    model = quality.train(stats, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept == {r.doc_id for r in stats.select("doc_id", quality.scored(model, "x").alias("s")).collect() if r.s >= 0.3}


def test_one_of_each_group_stays(stages):
    _, out = stages
    docs = sorted((r.doc_id, r.text) for r in out[1].collect())
    want = {docs[root][0] for _, root in brute([t for _, t in docs])}
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(want)


def test_rows_without_an_id_of_their_own_take_part_in_the_choice(spark):
    ship_package(spark)
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(None, "no id here, twice " + long), (None, "no id here, twice " + long), (None, long), (7, long), (7, long + " more"), (8, "one two"), (None, "three four")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in cp.keep_one_of_a_group(spark, docs.repartition(3), "").collect()]
    group = [t for i, t in found if "word5" in t]
    assert len(group) == 1 and [i for i, t in found if "word5" in t] == [7]
    assert sorted(t for _, t in found if "word5" not in t) == ["one two", "three four"]
    twice = docs.where("doc_id is null")
    assert len([t for t in cp.keep_one_of_a_group(spark, twice, "").collect() if "word5" in t.text]) == 1


def test_personal_data_is_gone(stages):
    _, out = stages
    before, after = ({r.doc_id: r for r in d.collect()} for d in out[2:4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == pii.redacted(before[i].text, pii.spans(before[i].text)) and r.n_chars == len(r.text)
        assert not brute_spans(r.text)
        if not pii.spans(before[i].text):
            assert r.text == before[i].text


def test_mix_comes_near_the_targets(stages):
    _, out = stages
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, own = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out[3].collect():
        size[r.source] += n_words(r.text)
    docs = {r.doc_id: r for r in out[3].collect()}
    for r in out[4].collect():
        taken[r.source] += n_words(r.text)
        own[r.doc_id] += n_words(r.text)
        assert set(re.split(r"[\x20\x09-\x0D]+", r.text.strip())) <= set(re.split(r"[\x20\x09-\x0D]+", docs[r.doc_id].text.strip()))
    assert all(abs(taken[s] - t) <= 20 + 0.002 * t for s, t in brute_targets(size).items())
    assert all(n <= 3 * n_words(docs[i].text) for i, n in own.items())


def test_ids_decode_to_the_text(stages):
    _, out = stages
    texts = sorted((r.doc_id, r.text) for r in out[4].collect())
    table = bpe.token_bytes(bpe.VOCABULARY)
    rows = [(r.doc_id, b"".join(table[i] for i in np.frombuffer(bytes(r.ids), "<u4")).decode()) for r in out[5].collect()]
    assert sorted(rows) == texts and out[5].where(~F.col("round_trip")).count() == 0


def test_run_equals_the_stages(spark, stages):
    sf, out = stages
    digest = lambda d: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in d.collect())
    assert digest(cp.run(spark, sf)) == digest(out[5])


def test_odd_documents_pass_every_stage(spark, stages):
    sf, _ = stages
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in cp.STAGES:
            docs = written_table(stage(spark, docs, sf), f"odd-{name}")
        assert docs.where(~F.col("round_trip")).count() == 0
