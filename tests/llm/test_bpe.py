"""Own encoders against the library they must agree with."""

import hashlib
import random
import weakref

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hazardframe.llm import bpe, common, counts, queries

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "\n", "a", "Hello  world\n\n next", "a   b", "a \n b\n", "x y  z　", "tab\tand\x0bmore\x1cfs \x1d x",
    "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|endoftext|", "don't I'LL we've 'S", "ΣΙΣ İstanbul été",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ababababab" * 50, "!!!!!!!! ???", "123 4567 12a3", "\U0001f600\U0001f600 你好 한글",
    "x" * 3000, "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(5000)), "\x85a\x85 b", "  lead", "trail  ",
    "  x y  ", "a\r\nb\r\n\r\nc", "é́ ́ b", "﻿bom", "\u0000nul", " 'ſt",
]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_word_bpe_is_the_library(texts):
    own, lib = bpe.word_bpe(WORDS), Tokenizer.from_file(WORDS)
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:80]
        assert own.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_counts_are_the_library(texts):
    own, lib = counts.byte_bpe(BYTES), Tokenizer.from_file(BYTES)
    for t, n in zip(texts, own.count(texts)):
        assert n == len(lib.encode(t, add_special_tokens=False).ids), t[:80]
        own.seen.clear()
        assert own.count([t]) == [n]


def test_segment_tree_takes_leftmost_lowest():
    rng = random.Random(5)
    for _ in range(300):
        pairs = rng.sample([(a, b) for a in range(6) for b in range(6)], 8)
        ranks = {p: r for r, p in enumerate(pairs)}
        made = [rng.randrange(6) for _ in pairs]
        symbols = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        plain = list(symbols)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]
            if not found:
                break
            r, i = min(found)
            plain[i : i + 2] = [made[r]]
        assert bpe.merge(symbols, lambda a, b: ranks.get((a, b)), made) == plain


def test_round_trip_query(spark):
    lib = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in queries.QUERIES["op2_bpe_round_trip"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frames_with_odd_rows(spark):
    rows = [(1, None, "q"), (1, "", "q"), (None, "two words", "z"), (7, "two words", "z"), (7, "two words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, WORDS).collect()
    assert sorted(len(r.ids) for r in out) == [0, 0, 2, 2, 2]
    assert {r.decoded for r in out} == {"", "two</w> words</w>"}
    n = counts.token_counts(df, BYTES, limit=1).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in n) == [(0, 0, False)] * 2 + [(9, 2, True)] * 3
    assert bpe.digests(df.limit(0), WORDS).count() == 0 == counts.token_counts(df.limit(0), BYTES).count()


def test_a_worker_holds_one_operators_words():
    words = bpe.word_bpe(WORDS)
    words.encode("some words to remember")
    gone = weakref.ref(words)
    del words
    assert bpe.word_bpe(WORDS) is gone()
    counts.byte_bpe(BYTES)
    assert gone() is None
    common.let_go()
    assert not common._held
