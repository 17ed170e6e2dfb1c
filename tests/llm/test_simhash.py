"""SimHash groups against a plain all-pairs version."""

import random

import numpy as np
import pytest
import xxhash

from hazardframe.llm import queries, simhash

DATA = "/root/testdata/sf0.001"


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius=4):
    """rows: (id, print) -> {index: least id}"""
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(n)]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, plain_print(r.text)) for r in docs]
    want = sorted((k, f"{p:016x}", c) for (k, p), c in zip(rows, plain_groups(rows)))
    assert sorted(map(tuple, queries.QUERIES["op4_simhash"](spark, DATA).collect())) == want


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (None, "A B C D E F", 2),
            (None, "lonely words stand here now", 2), (9, "x " * 60_000, 3), (8, "x\tx\nx", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(map(repr, (tuple(r) for r in simhash.near_duplicates(df).collect())))
    prints = [(r[0], plain_print(r[1])) for r in rows]
    want = [(k, p - (1 << 64) if p >> 63 else p, c) for (k, p), c in zip(prints, plain_groups(prints))]
    assert got == sorted(map(repr, want))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [3, 64, 2048])
def test_links_keep_components_at_any_cell_size(spark, cell):
    rng = random.Random(cell)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(8)}
    values = sorted(values | set(base))
    signed = [(int(np.array(v, np.uint64).view(np.int64)),) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.links(frame, cell=cell)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    rows = [(s[0], v) for s, v in zip(signed, values)]
    want = {}
    for (k, _), c in zip(rows, plain_groups(rows)):
        want.setdefault(c, set()).add(k)
    assert groups == {c: m for c, m in want.items() if len(m) > 1}


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    values[1::2] = values[::2] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    for radius in (0, 1, 3, 4, 7, 12):
        plane, first, words, _ = simhash.planes(np.zeros(300, int), values)
        items = [(q, w) for q in range(300) for w in range(int(words[0]))]
        q, w = (np.array(x) for x in zip(*items))
        hit, bits = simhash.near(plane, w, values[q], radius)
        got = {(int(q[i]), int(w[i]) * 64 + b) for i, m in zip(hit, bits) for b in range(64) if int(m) >> b & 1}
        want = {(i, j) for i in range(300) for j in range(300) if bin(int(values[i] ^ values[j])).count("1") <= radius}
        assert {x for x in got if x[1] < 300} == want


def test_representatives_of_null_and_reused_ids(spark):
    one, two, three = ("".join(random.Random(n).choices("abcdefgh     ", k=400)) for n in range(3))
    four = "".join(random.Random(9).choices("ijklmnop     ", k=400))
    rows = [(None, one, "a"), (None, two, "b"), (None, two, "b"), (7, three, "c"), (7, four, "d"), (7, four, "d"),
            (8, four, "e"), (None, three, "f"), (5, "", "g"), (6, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.representatives(df)
    want = [(None, one, "a"), (None, two, "b"), (7, three, "c"), (7, four, "d"), (5, "", "g")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and got.columns == df.columns


def test_clashing_column_names_stay(spark):
    rows = [(1, "some words of a text here", "a", "b", 7), (2, "some words of a text here", "c", "d", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, __head string, fp int")
    assert [tuple(r) for r in simhash.representatives(df).collect()] == [rows[0]]
    assert simhash.representatives(df.limit(0)).columns == df.columns
