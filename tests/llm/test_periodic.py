"""Periodic runs against a plain search of all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hazardframe.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """Every lag's unbroken lines of matches; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                found.setdefault((s - q, i - s + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_all_lags(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len((r.text or "").split()) <= 2500}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if r.doc_id in short:
            assert got[r.doc_id] == plain_row(r.doc_id, r.text)
    assert sum(row[1] > 0 for row in got.values()) > 10


@pytest.mark.parametrize("letters, length", [(1, 40), (2, 60), (2, 200), (3, 90), (4, 300)])
def test_both_ways_on_random_words(letters, length, monkeypatch):
    rng = random.Random(letters * 1000 + length)
    for _ in range(150):
        words = [b"abcd"[rng.randrange(letters) :][:1] for _ in range(rng.randrange(length))]
        for _ in range(rng.randrange(4)):
            if words:
                a, p = rng.randrange(len(words)), rng.randrange(1, 1 + len(words))
                words = words[:a] + (words[a:][:p] * 20)[: rng.randrange(1, length)]
        for least in (4, 7, 12):
            want = plain_runs(words, least)
            ids = np.array([ord(w) for w in words], np.int64)
            for limit in (0, 10**9):
                monkeypatch.setattr(periodic, "PAIRS", limit)
                assert periodic.find(words, least) == want
            if len(words) > 1:
                assert periodic.by_blocks(np.unique(ids, return_inverse=True)[1].astype(np.int64), least) == want


def test_nested_runs_of_a_long_text():
    inner = [b"a", b"b"] * 500 + [b"c"]
    words = inner * 60  # 60 060 words: periods 2 and 1001
    found = periodic.find(words)
    assert len(found) == 61 and (0, len(words), 1001) in found and (0, 1000, 2) in found
    assert periodic.collapsed(words, found) == b"a b c"
    assert periodic.find([b"x"] * 300_000) == [(0, 300_000, 1)]


def test_odd_rows(spark):
    again = "go on and on " * 4
    rows = [(1, None, 5), (2, "", 5), (None, again, 2), (None, again, 2), (7, again, 1), (7, "\t\n ", 1),
            (41, "x " * 50_000, 3), (5, "é é ü " * 9, 4), (50, "solo", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = sorted(map(repr, map(tuple, periodic.digests(df.where("doc_id is null or doc_id <> 41")).collect())))
    assert got == sorted(repr(plain_row(k, t)) for k, t, _ in rows if k != 41)
    assert sorted(tuple(r) for r in periodic.runs(df.where("doc_id = 41")).collect()) == [(41, 0, 50_000, 1)]
    assert [r.text for r in periodic.collapse(df.where("doc_id = 7 and text like 'go%'")).collect()] == ["go on and on"]
    assert periodic.digests(df.limit(0)).count() == periodic.runs(df.limit(0)).count() == 0
