"""Jaccard components against all pairs of plain sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import jaccard, queries

DATA = "/root/testdata/sf0.001"


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain(rows):
    """rows: (key, text) -> sorted (key, size, component)"""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(map(repr, ((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets)))))


def found(df):
    return sorted(map(repr, map(tuple, jaccard.near_duplicates(df).collect())))


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(repr, map(tuple, queries.QUERIES["op11_jaccard_join"](spark, DATA).collect())))
    assert got == plain([tuple(r) for r in docs])


def copies(rng, count, length, changed):
    """Near copies in chains: each changes words of an earlier one."""
    texts = [[f"w{rng.randrange(500)}" for _ in range(length)]]
    while len(texts) < count:
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(changed + 1)):
            words[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        texts.append(words)
    return [" ".join(words) for words in texts]


@pytest.mark.parametrize("few", [0, 10**6])
def test_groups_of_near_copies(spark, few, monkeypatch):
    """With leaders until no link is left, and with all pairs across components at once."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(11)
    texts = copies(rng, 60, 100, 2) + copies(rng, 40, 30, 1)
    passage = " ".join(f"p{i}" for i in range(85))  # 85 of 100 words shared: similar, but not enough
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(15)) for _ in range(30)]
    texts += [f"short text {i % 3}" for i in range(9)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == plain(rows)


def test_the_bound_is_met_exactly(spark):
    """Sets of 9 with 8 in common have 8 / 10 = 0.8; of 8 with 7 in common, 7 / 9."""
    words = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12] + ["b"])), (3, " ".join(words[:8] + ["c"])), (4, " ".join(words[:12])),
            (5, " ".join(words[:11] + ["d"])), (6, " ".join(words[:5])), (7, " ".join(words[:5]).upper()), (8, " ".join(words[:4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == plain(rows)


def test_levels_do_not_change_the_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120")
    want = found(docs)
    levels = lambda df, text: np.random.default_rng(1).integers(0, 8, 64).astype(np.uint8)
    monkeypatch.setattr(jaccard, "frequency_levels", levels)
    monkeypatch.setattr(jaccard, "SMALL_ROWS", 0)
    monkeypatch.setattr(jaccard, "SMALL_SHINGLES", 0)
    assert found(docs) == want


def test_odd_rows(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    rows = [(None, long, 1), (None, long, 1), (5, long.upper(), 2), (5, long.upper(), 2), (5, "other words of the same key here", 2),
            (9, None, 3), (8, "", 3), (None, " \t\n", 3), (7, "x " * 60_000, 4), (6, "x\tx\x0bx x\nx", 4), (None, "alone in the world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    assert found(df) == plain([r[:2] for r in rows])
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    assert found(df.select("doc_id", F.lit(None).cast("string").alias("text"))) == plain([(r[0], None) for r in rows])


def test_shared_postings_across_batches():
    """Neighbours meet over the borders of batches; repeated postings of a class are one."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(60), rng.randrange(4), 10, 1) for _ in range(200)) + [(99, 1, 10, 1)] * 7
    classes = {}
    for token, node, _, _ in rows:
        classes.setdefault(token, set()).add(node)
    want = sorted({r for r in rows if len(classes[r[0]]) > 1})
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
    for size in (1, 2, 3, 7, 500):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*p), schema)], schema=schema) for p in parts]
        got = [tuple(r.values()) for b in jaccard.shared(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == want and len(got) == len(want)


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 5, 31, 32, 33, 200, 1000):
        a = np.unique(rng.integers(0, 2**60, n).astype(np.uint64))
        for m in (1, n // 4 + 1, n):
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 2**60, m).astype(np.uint64)]))
            x, y = jaccard.parity(a), jaccard.parity(b)
            if len(x) == len(y):
                differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
                assert differ <= len(np.setxor1d(a, b))
        assert len(jaccard.parity(a)) * 64 >= 2 * len(a)
