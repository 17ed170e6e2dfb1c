"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hazardframe.llm import collocation, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, least=30, top=2000):
    """rows: (text, lang)"""
    count, total = {}, Counter()
    for text, lang in rows:
        f = count.setdefault(lang or ("und" if lang is None else ""), Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or ("und" if lang is None else "")] += len(w)
            for k in range(1, 5):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * f[p[i : i + k]]:
                        gone.add(p[i : i + k])
        scored = []
        for p, a in cands.items():
            if p not in gone:
                s, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def test_query_against_plain_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").collect()
    got = sorted(map(tuple, queries.QUERIES["op13_collocations"](spark, DATA).collect()))
    assert got == plain([tuple(r) for r in docs]) and len(got) > 30


def random_rows():
    rng = random.Random(5)
    words = ["a", "b", "C", "d", "é", "x.y", "ö;", "z\t", "end\n"]
    return [(" ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randrange(400))), rng.choice(["en", "de", None])) for _ in range(60)]


def test_random_words(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = [tuple(r) for r in collocation.collocations(df, 30, 9).collect()]
    assert sorted(got) == plain(rows, 30, 9) and len(got) == 27


@pytest.mark.parametrize("chunk", [1, 3, 7, 100])
def test_cut_texts_count_each_phrase_once(chunk, monkeypatch):
    rows = random_rows()[:20]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t.encode() for t, _ in rows]), pa.array([(x or "und").encode() for _, x in rows])], names=["text", "lang"])

    def counts():
        found = Counter()
        for known, numbers, own, of, langs in collocation.chunks(iter([batch])):
            for k, at, h in collocation.grams(known, numbers, own, of, langs):
                code = collocation.phrase_codes(numbers, of, at, k)
                assert len(set(code.tolist())) == len(set(h.tolist()))
                for i in at.tolist():
                    found[langs[of[i]], b" ".join(known.words[x] for x in numbers[i : i + k])] += 1
        return found

    whole = counts()
    monkeypatch.setattr(collocation, "CHUNK", chunk)
    monkeypatch.setattr(collocation, "VOCABULARY", 5)
    assert counts() == whole


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    stream = np.concatenate([rng.integers(0, 50_000, 200_000), np.repeat(np.arange(90_000, 90_020), 30)]).astype(np.uint32)
    rng.shuffle(stream)
    summary = collocation.Summary(len(stream) // 30 + 1)
    for part in np.array_split(stream, 40):
        key, n = np.unique(part, return_counts=True)
        summary.merge(key, n)
    summary.settle()
    key, n = np.unique(stream, return_counts=True)
    assert set(key[n >= 30]) <= set(summary.frequent(30).tolist())
    assert summary.lost < 30 and len(summary.keys[0]) <= summary.capacity


def test_odd_rows(spark):
    text = "New York, new york! " * 20
    rows = [(1, None, "en", 1), (2, "", None, 1), (None, text, None, 2), (None, text, None, 2), (3, text, "", 2),
            (4, "w " * 50_000, "xx", 3), (5, "\n\r\x0b.;", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase int")
    got = sorted(map(tuple, collocation.collocations(df).collect()))
    assert got == plain([(r[1], r[2]) for r in rows])
    assert ("und", 1, "new york", 80, 80, 80, 160, 1_000_000) in got
    assert collocation.collocations(df.limit(0)).count() == 0
