"""Phrase collocations by mergeable Misra-Gries summaries.

First pass: tasks count the hashed word n-grams of their texts chunk by chunk and send each hash
partition its counters, as a summary that has lost nothing. A partition merges them into one
Misra-Gries summary: counters are added, and whenever there are too many, the count of the first
one beyond the capacity is taken off all. Each such step takes its amount off more than `capacity`
counters, so with a capacity above mass / least no n-gram loses `least` occurrences and each
frequent one survives. The survivors are marked in a bit map of bounded size, one stretch of it per
partition. Second pass: n-grams whose bit is set are counted exactly, by their words; an n-gram
that shares a bit with a survivor costs a row and is left out by its count.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map, keep

LEAST = 30
WORDS = 4
TOP = 2000
#: A longer phrase with this percentage of a candidate's occurrences stands for it.
SHARE = 80
SCALE = 2_000_000
#: Capacity of a summary in units of mass / least: the loss of a counter is below least / SLACK.
SLACK = 4
#: Tokens that one step counts at once, words that a task remembers, phrases that it holds.
CHUNK, VOCABULARY, HELD = 300_000, 300_000, 500_000
#: Bytes of text a hash partition is made for, and bounds of the two powers of two.
PARTITION_BYTES, MOST_PARTITION_BITS, MOST_MAP_BITS = 8_000_000, 18, 29
_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=1)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case words; b"." stands between pieces."""
    return (text or b"").translate(_PIECES).replace(b".", b" . ").split()


class Vocabulary(dict):
    """word: number; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words, self.hashes = [b"."], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word) or 1)
        return number


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(vocabulary, word numbers, whether a phrase may start here, language numbers, languages) of
    batches (text, lang). A text that is cut is continued by the next chunk, which it overlaps by
    the words a phrase may still have."""
    known = Vocabulary()
    numbers: list[int] = []
    sizes: list[tuple[int, int, int]] = []  # (tokens, of these only read, language)
    langs: dict[bytes, int] = {}

    def done():
        own = np.ones(len(numbers), bool)
        at = 0
        for size, over, _ in sizes:
            at += size
            own[at - over : at] = False
        of = np.repeat(np.array([s[2] for s in sizes], np.int64), [s[0] for s in sizes])
        return known, np.array(numbers, np.int64), own, of, list(langs)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            number = langs.setdefault(lang.as_py(), len(langs))
            found = tokens(text.as_py())
            for at in range(0, len(found), CHUNK):
                part = found[at : at + CHUNK + WORDS - 1]
                numbers += map(known.__getitem__, part)
                numbers.append(0)
                sizes.append((len(part) + 1, max(0, len(part) - CHUNK) + 1, number))
                if len(numbers) >= CHUNK:
                    yield done()
                    numbers, sizes, langs = [], [], {}
                    if len(known) > VOCABULARY:
                        known = Vocabulary()
                    if at + CHUNK < len(found):
                        number = langs.setdefault(lang.as_py(), 0)
    if numbers:
        yield done()


def grams(known: Vocabulary, numbers: np.ndarray, own: np.ndarray, of: np.ndarray, langs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of all phrases of k words, k from 1 to WORDS; a language's are its own."""
    word = np.frombuffer(known.hashes, np.uint64)[numbers]
    salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], np.uint64)
    h = word ^ salt[of]
    ok = own & (numbers > 0)
    for k in range(1, WORDS + 1):
        if k > 1:
            h = h[:-1] + word[k - 1 :]
            ok = ok[:-1] & (numbers[k - 1 :] > 0)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        at = np.flatnonzero(ok)
        yield k, at, h[at]


def _languages(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").cast("binary"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).cast("binary"))


def packed(data: bytes | np.ndarray) -> bytes:
    """Compressed bytes, of an array plane by plane; the size stands in front."""
    if isinstance(data, np.ndarray):
        data = data.view(np.uint8).reshape(len(data), data.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unpacked(data: bytes, kind: type | None = None) -> bytes | np.ndarray:
    raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    if kind is None:
        return raw
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters of several summaries together, by key."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count[order], first) if len(key) else count


class Summary:
    """Misra-Gries counters of one hash partition."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self.waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        self.keys.append(keys), self.counts.append(counts.astype(np.int64))
        self.lost += lost
        self.waiting += len(keys)
        if self.waiting > max(self.capacity, 100_000):
            self.settle()

    def settle(self) -> None:
        key, count = add(self.keys, self.counts)
        if len(key) > self.capacity:
            off = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            self.lost += off
            left = count > off
            key, count = key[left], count[left] - off
        self.keys, self.counts, self.waiting = [key], [count], 0

    def frequent(self, least: int) -> np.ndarray:
        """Every key of `least` occurrences, and others that may have as many."""
        self.settle()
        return self.keys[0][self.counts[0] + self.lost >= least]


def survivors(docs: DataFrame, least: int, text: str, lang: str) -> np.ndarray:
    """Bytes of a bit map over the leading bits of n-gram hashes, set for all frequent n-grams."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    bits = min(max(size // PARTITION_BYTES, 31).bit_length(), MOST_PARTITION_BITS)
    map_bits = min(bits + 20, MOST_MAP_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(1 << bits, np.int64)
        for chunk in chunks(batches):
            code = np.concatenate([h for _, _, h in grams(*chunk)]) >> np.uint64(32 - bits)
            code, n = np.unique(code, return_counts=True)
            part = (code >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(part)).tolist()
            some = part[first]
            mass[some] += np.add.reduceat(n, first) if len(part) else 0
            key, n = code.astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32)
            spans = list(zip(first.tolist(), ends, strict=True))
            # ascending keys go as differences
            steps = [packed(np.diff(key[s:e], prepend=np.uint32(0))) for s, e in spans]
            yield _rows(some, [1] * len(some), [0] * len(some), steps, [packed(n[s:e]) for s, e in spans])
        some = np.flatnonzero(mass)
        yield _rows(some, [0] * len(some), mass[some], [b""] * len(some), [b""] * len(some))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None

        def marked() -> pa.RecordBatch:
            keys = summary.frequent(least)
            stretch = np.zeros(1 << (map_bits - bits), np.uint8)
            stretch[keys >> np.uint32(32 - (map_bits - bits))] = 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(stretch).tobytes()], pa.binary())], names=["part", "marks"])

        for batch in batches:
            for p, order, m, keys, counts in zip(*batch.columns, strict=True):
                if p.as_py() != part:
                    if summary is not None:
                        yield marked()
                    part, mass, summary = p.as_py(), 0, None
                if order.as_py() == 0:
                    mass += m.as_py()  # masses come first
                    continue
                if summary is None:
                    summary = Summary(SLACK * mass // least + 1)
                summary.merge(np.cumsum(unpacked(keys.as_py(), np.uint32), dtype=np.uint32), unpacked(counts.as_py(), np.uint32))
        if summary is not None:
            yield marked()

    rows = arrow_map(_languages(docs, text, lang), count, "part int, place int, mass long, keys binary, counts binary")
    rows = rows.repartition("part").sortWithinPartitions("part", "place")
    marks = np.zeros(1 << (map_bits - 3), np.uint8)
    stretch = 1 << (map_bits - bits - 3)
    for row in arrow_map(rows, merge, "part int, marks binary").collect():  # 2^29 bits together at most
        marks[row.part * stretch : (row.part + 1) * stretch] = np.frombuffer(row.marks, np.uint8)
    return marks


def _rows(part, place, mass, keys, counts) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    arrays = [pa.array(x, k) for x, k in zip((part, place, mass, keys, counts), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "place", "mass", "keys", "counts"])


def phrase_codes(numbers: np.ndarray, of: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A number for each place's phrase of k words and language, equal where these are equal."""
    width = int(numbers.max(initial=1)).bit_length()
    code = of[at]
    bits = int(code.max(initial=1)).bit_length()
    for j in range(k):
        if bits + width > 63:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            bits = len(code).bit_length()
        code = code << width | numbers[at + j]
        bits += width
    return code


def counted(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to 4 words with f >= least occurrences, exact, and
    one row with k = 0 and an empty phrase for the number of words of each language."""
    marks = survivors(docs, least, text, lang)
    spread = docs.sparkSession.sparkContext.broadcast(marks)
    drop = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
    parts = max(1, len(marks) >> 16)  # half a million bits, so few enough phrases, each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = spread.value
        held: dict[bytes, int] = defaultdict(int)
        for chunk in chunks(batches):
            known, numbers, own, of, langs = chunk
            for k, at, h in grams(*chunk):
                if k == 1:
                    for i, n in enumerate(np.bincount(of[at], minlength=len(langs)).tolist()):
                        held[langs[i] + b"\n"] += n
                bit = h >> drop
                at = at[(marked[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1]
                _, first, n = np.unique(phrase_codes(numbers, of, at, k), return_index=True, return_counts=True)
                first = at[first]
                words = [[known.words[x] for x in numbers[first + j].tolist()] for j in range(k)]
                for number, count, *phrase in zip(of[first].tolist(), n.tolist(), *words, strict=True):
                    held[langs[number] + b"\n" + b" ".join(phrase)] += count
            if len(held) > HELD:
                yield _packed(held, parts)
                held.clear()
        yield _packed(held, parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = -1, defaultdict(int)
        for batch in batches:
            for p, sizes, data, counts in zip(*batch.columns, strict=True):
                if p.as_py() != part:
                    yield _frequent(total, least)
                    part, total = p.as_py(), defaultdict(int)
                at, data = 0, unpacked(data.as_py())
                for size, n in zip(unpacked(sizes.as_py(), np.uint32).tolist(), unpacked(counts.as_py(), np.int64).tolist(), strict=True):
                    total[data[at : at + size]] += n
                    at += size
        yield _frequent(total, least)

    rows = arrow_map(_languages(docs, text, lang), count, "part int, sizes binary, data binary, counts binary")
    rows = rows.repartition("part").sortWithinPartitions("part")
    rows = arrow_map(rows, add, "lang binary, k int, phrase binary, f long")
    return rows.select(F.col("lang").cast("string").alias("lang"), "k", F.col("phrase").cast("string").alias("phrase"), "f")


def _packed(held: dict[bytes, int], parts: int) -> pa.RecordBatch:
    """One row per part: its keys (language, line end, phrase) in order, their sizes and counts."""
    of: dict[int, list[bytes]] = defaultdict(list)
    for key in held:
        of[xxhash.xxh64_intdigest(key) % parts].append(key)
    for keys in of.values():
        keys.sort()  # neighbours begin alike, which packs well
    arrays = [
        pa.array(list(of), pa.int32()),
        pa.array([packed(np.array([len(k) for k in keys], np.uint32)) for keys in of.values()], pa.binary()),
        pa.array([packed(b"".join(keys)) for keys in of.values()], pa.binary()),
        pa.array([packed(np.array([held[k] for k in keys], np.int64)) for keys in of.values()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "sizes", "data", "counts"])


def _frequent(total: dict[bytes, int], least: int) -> pa.RecordBatch:
    """(lang, k, phrase, f) of a part's frequent phrases and of the numbers of words (k = 0)."""
    rows = [(*key.rpartition(b"\n"), n) for key, n in total.items()]
    rows = [(lang, phrase.count(b" ") + 1 if phrase else 0, phrase, n) for lang, _, phrase, n in rows if n >= least or n and not phrase]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = pa.binary(), pa.int32(), pa.binary(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "k", "phrase", "f"])


def _words(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer phrase stands for.

    `counts` is as `counted` gives it; each part of a frequent phrase is as frequent, so it is there.
    """
    phrases = counts.filter("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    parts = counts.filter("k >= 1").select("lang", "phrase", "f")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "a", "words", "k", cut).select(
        "lang", "phrase", "a", "cut", _words(1, F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    # Decimals hold products and sums beyond 64 bits; a <= l, r, so the quotient is at most SCALE / 2.
    value = F.expr(f"cast((cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cuts.withColumn("score", value).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"))
    longer = phrases.filter("k >= 3").select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "words", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("from"))
    longer = longer.select("lang", "a", _words(F.col("from"), F.col("size")).alias("phrase"))
    cover = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    words = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    left = best.join(cover, ["lang", "phrase"], "left").filter(
        F.coalesce(F.expr(f"cast(100 as decimal(20,0)) * cover < cast({share} as decimal(20,0)) * a"), F.lit(True)))
    return left.join(words, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language the first `top` phrases of 2 to 4 words by score, then count, then bytes.

    Words are lower-cased in A-Z and stand between blanks and tabs; no phrase crosses one of
    .,;:!? or a line end. A null language is `und`; null and empty texts have no word; repeated rows
    count each. The score of a phrase is 2 * 10^6 * a / (l + r), floored, at its weakest cut. Further
    columns are ignored. An empty table, or one without a frequent phrase, gives an empty result.
    """
    found = keep(scored(keep(counted(docs, least, text, lang), "phrases")), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first rows are among the first of each of its parts, which are bounded.
    parts = found.count() // 100_000 + 1
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = found.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = some.filter(F.col("at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
