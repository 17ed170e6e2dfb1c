"""Periodic runs of words, found by an online sparse dynamic programme over diagonals.

A run of period q is a stretch whose words equal those q places before; on the diagonal of lag q it
is an unbroken line of matches. Words are read once, from left to right: the earlier places of the
gram that starts here name the lags that match here, a lag that matched one place before goes on,
and a lag that does not match any more ends and yields its run at once. A run of `least` words has at
least half as many matches in a row, so places are compared by grams of that length, and texts without a
repeated gram need no table at all.

The table grows with the pairs of equal grams, which is the square of a text's length where one word
repeats all along. Texts with more than `PAIRS` such pairs a word find the same diagonals by blocks
of doubling length: lags from 2^k to 2^(k+1) are those at which a block of 2^(k-1) words, one in each
2^(k-1) places, comes again; a match is then extended to its full line by ranks of all blocks. That
takes n log n steps for any text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map

LEAST = 12
#: Pairs of equal grams a word, beyond which diagonals are found by blocks.
PAIRS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def words_of(text: bytes | None) -> list[bytes]:
    """Words between blanks and the characters 9 to 13."""
    return (text or b"").split()


def _ranks(code: np.ndarray) -> np.ndarray:
    return np.unique(code, return_inverse=True)[1].astype(np.int64)


def _pairs(rank: np.ndarray, gap: int) -> np.ndarray:
    """Ranks of the pairs of a place's rank and that of the place `gap` later."""
    return _ranks(rank[:-gap] * len(rank) + rank[gap:])


def _repeats(words: Sequence[bytes], size: int) -> bool:
    """Whether a gram may occur twice: no equal gram is missed, an unequal one hardly ever taken."""
    if len(words) <= size:
        return False
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    gram = one[: len(one) - size + 1].copy()
    for k in range(1, size):
        gram = (gram ^ (gram >> np.uint64(31))) * _MIX + one[k : len(one) - size + 1 + k]
    gram.sort()
    return bool((gram[1:] == gram[:-1]).any())


def find(words: Sequence[bytes], least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) by start, then period: stretches of smallest period q that
    have max(least, 2q) words or more and that no neighbouring word extends."""
    size = (least + 1) // 2
    if not _repeats(words, size):
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    gram, block = ids, 1
    while block * 2 <= size:
        gram = _pairs(gram, block)
        block *= 2
    if block < size:
        gram = _pairs(gram, size - block)
    counts = np.bincount(gram)
    if int((counts * (counts - 1) // 2).sum()) > PAIRS * len(words):
        return by_blocks(ids, least)
    at = np.flatnonzero(counts[gram] > 1)
    return online(at.tolist(), gram[at].tolist(), len(words), size, least)


def online(at: list[int], grams: list[int], n: int, size: int, least: int) -> list[Run]:
    """The programme itself, over the places of grams that occur more than once."""
    smallest: dict[tuple[int, int], int] = {}

    def end(lag: int, first: int, last: int) -> None:
        matched = last - first + size
        if matched >= lag and matched + lag >= least:
            stretch = (first - lag, matched + lag)
            smallest[stretch] = min(lag, smallest.get(stretch, lag))

    earlier: dict[int, list[int]] = {}
    active: dict[int, int] = {}  # lag: the place from which it has matched
    before = -2
    for i, gram in zip(at, grams, strict=True):
        if i != before + 1:
            for lag, first in active.items():
                end(lag, first, before)
            active = {}
        places = earlier.setdefault(gram, [])
        going: dict[int, int] = {}
        room = n - i
        for j in places:
            lag = i - j
            first = active.pop(lag, None)
            if first is not None:
                going[lag] = first
            elif lag <= room:  # else too few words are left to match as many as the lag
                going[lag] = i
        for lag, first in active.items():
            end(lag, first, before)
        active = going
        places.append(i)
        before = i
    for lag, first in active.items():
        end(lag, first, before)
    return sorted((start, length, lag) for (start, length), lag in smallest.items())


def by_blocks(ids: np.ndarray, least: int) -> list[Run]:
    """The same runs by blocks of doubling length."""
    n = len(ids)
    rank = [ids]  # rank[k][i]: of the 2^k words from i
    while 2 ** len(rank) <= n:
        rank.append(_pairs(rank[-1], 2 ** (len(rank) - 1)))
    found = []  # (first match, matches, lag)
    for lag in range(1, min(8, n)):
        same = np.concatenate(([False], ids[lag:] == ids[:-lag], [False]))
        turn = np.flatnonzero(same[1:] != same[:-1])
        first, last = turn[::2] + lag, turn[1::2] + lag
        found.append(np.stack([first, last - first, np.full(len(first), lag)]))
    for k in range(3, len(rank)):
        low, high, step = 2**k, 2 ** (k + 1) - 1, 2 ** (k - 1)
        of = rank[k - 1]
        code = np.sort(of * (n + 1) + np.arange(len(of)))
        anchor = np.arange(0, len(of), step)
        anchor = anchor[anchor >= low]
        base = of[anchor] * (n + 1)
        begin = np.searchsorted(code, base + np.maximum(anchor - high, 0))
        count = np.searchsorted(code, base + anchor - low, side="right") - begin
        i = np.repeat(anchor, count)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        j = code[np.repeat(begin, count) + nth] % (n + 1)
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in range(len(rank) - 1, -1, -1):
            r, size = rank[level], 2**level
            inside = i + right + size <= n
            a, b = np.where(inside, i + right, 0), np.where(inside, j + right, 0)
            right += size * (inside & (r[a] == r[b]))
            inside = j - left - size >= 0
            a, b = np.where(inside, i - left - size, 0), np.where(inside, j - left - size, 0)
            left += size * (inside & (r[a] == r[b]))
        found.append(np.stack([i - left, left + right, i - j]))
    first, matched, lag = np.concatenate(found, axis=1)
    good = (matched >= lag) & (matched + lag >= least)
    first, matched, lag = first[good], matched[good], lag[good]
    order = np.lexsort((lag, matched + lag, first - lag))
    runs = np.stack([(first - lag)[order], (matched + lag)[order], lag[order]])
    new = np.ones(len(order), bool)  # of one stretch's periods the smallest
    new[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return [tuple(run) for run in runs[:, new].T.tolist()]


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words joined by blanks, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """Words made periodic in a tenth of the texts, those whose key's crc32 ends in the digit 0."""
    if key is None or not words:
        return words
    h = zlib.crc32(b"%d" % key)
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _scan(docs: DataFrame, text: str, key: str, least: int, change: Callable | None, schema: str, row: Callable) -> DataFrame:
    """One output row per document: its key and what `row(words, runs)` makes of it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(t.as_py())
                if change is not None:
                    words = change(k.as_py(), words)
                out.append(row(words, find(words, least)))
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [
                pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    fields = [field.split(" ", 1) for field in schema.split(", ")]
    names = [key, *[f[0] for f in fields]]
    kinds = [_KINDS[f[1]] for f in fields]
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary"))
    return arrow_map(own, of, f"`{key}` {kind}, {schema}")


_KINDS = {
    "long": pa.int64(),
    "string": pa.string(),
    "array<struct<start:long,length:long,period:long>>": pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
}


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, change: Callable | None = None) -> DataFrame:
    """(key, start, length, period) of every run of every text, places numbered from 0.

    Null and empty texts have no run. Repeated rows give their runs each; a null key stays null.
    Further columns are ignored. An empty table gives an empty result.
    """
    listed = _scan(docs, text, key, least, change, "found array<struct<start:long,length:long,period:long>>",
                   lambda words, found: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in found],))
    return listed.select(F.col(f"`{key}`"), F.explode("found").alias("r")).select(F.col(f"`{key}`"), "r.*")


def collapse(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(key, text) with each run cut to its first period; words are joined by one blank.

    Null texts become empty. Rows, keys and further columns as in `runs`.
    """
    return _scan(docs, text, key, least, None, f"{text} string", lambda words, found: (collapsed(words, found).decode("utf-8", "replace"),))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, change: Callable | None = planted) -> DataFrame:
    """Per row: key, n_runs, the longest run (start, length, period, exponent_milli; ties go to the
    smallest start, then period; nulls without a run) and SHA-256 of the run list and of the
    collapsed text.

    `change(key, words)` rewrites the words first. Null and empty texts have no word, and no row is
    left out; a row without a key keeps its words as they are. Further columns are ignored.
    """

    def row(words: list[bytes], found: list[Run]) -> tuple:
        start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        return (len(found), start, length, period, 1000 * length // period if found else None,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest())

    return _scan(docs, text, key, least, change, "n_runs long, start long, length long, period long, exponent_milli long, "
                 "runs_sha256 string, collapsed_sha256 string", row)
