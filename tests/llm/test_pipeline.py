"""The pipeline's stages against plain decisions on their own input."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hazardframe.llm import decontaminate
from tests.llm.test_simhash import plain_groups, plain_print

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "bpe"]
    for df in states[1:-1]:
        assert df.columns == states[0].columns


def test_quality_keeps_good(spark, states):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = set(ids(states[1]))
    good = [r.doc_id for r in states[0].collect() if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 20]
    assert sum(x in kept for x in good) >= 0.98 * len(good)
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(x in kept for x in bad) <= 0.1 * len(bad)


def test_one_of_each_group(states):
    rows = [(r.doc_id, plain_print(r.text)) for r in states[1].select("doc_id", "text").collect()]
    assert ids(states[2]) == sorted(set(plain_groups(rows)))


def test_leaking_documents_go(spark, states):
    bad = {r.doc_id for r in decontaminate.leaks(states[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert bad and ids(states[3]) == sorted(set(ids(states[2])) - bad)


def test_tokens(states):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in states[4].collect()}
    docs = states[3].collect()
    assert len(got) == len(docs)
    for d in docs:
        want = lib.encode(d.text, add_special_tokens=False).ids
        assert np.array_equal(got[d.doc_id].ids, want) and got[d.doc_id].decoded == lib.decode(want, skip_special_tokens=False)
