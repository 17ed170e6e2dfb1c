"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Texts are cut into runs of word characters and runs of other marks; unigrams and bigrams of these
tokens are hashed into a fixed number of buckets. The raw multinomial counts every document; the
target multinomial counts half of a bounded sample of labelled good documents. A document's score
is the mean log ratio over its n-grams, so that length does not count, and one threshold, fitted
on the other half of the sample, decides every document the same way.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map, keep, only, slices

#: Buckets of the two multinomials, as a power of two; bounds what reaches the driver (1 MB).
BUCKET_BITS = 17
#: Pseudo-count of every bucket; large, so that a rare word says little.
SMOOTHING = 8.0
#: Most labelled documents used to fit; chosen by the hash of their id.
LABELLED = 20_000
#: Least words, most hundredths of words in repeated windows, words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Distinct words a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 400_000
BIN = 1000.0

_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Words(dict):
    """Numbers of distinct words, each with the hashes of its tokens."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.ends = array("Q"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        for token in _TOKEN.findall(word.decode("utf-8", "replace")):
            self.hashes.append(xxhash.xxh64_intdigest(token.encode("utf-8", "replace")))
        self.ends.append(len(self.hashes))
        self[word] = number = len(self)
        return number


@dataclass
class Measures:
    """Base figures of one text, and its words as numbers."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    numbers: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * _ODD[1] + mixed[k : k + n]
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    change = np.zeros(len(numbers) + 1, np.int64)
    change[at] += 1
    change[at + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def measure(text: str, words: Words) -> Measures:
    raw = text.encode("utf-8", "replace")
    split = raw.split()
    numbers = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
    lines = text.split("\n")
    seen: set[str] = set()
    again = 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                again += bool(line.strip(" \t\n\x0b\x0c\r"))
            else:
                seen.add(line)
    return Measures(
        n_words=len(split),
        word_chars=len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        n_symbols=len(raw) - len(raw.translate(None, _SYMBOLS)),
        n_dup_lines=again,
        n_repeat_words=repeated_words(numbers),
        numbers=numbers,
    )


def _buckets(numbers: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text's tokens."""
    begin, size = ends[numbers], ends[numbers + 1] - ends[numbers]
    total = int(size.sum())
    at = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
    one = hashes[at]
    two = (one[:-1] * _ODD[1] + one[1:]) * _ODD[2]
    return (np.concatenate((one * _ODD[0], two)) >> np.uint64(64 - bits)).astype(np.int64)


def _measured(texts: list[str | None], bits: int, state: dict) -> Iterator[tuple[Measures, np.ndarray]]:
    """Measures and n-gram buckets of each text, in order."""
    for run in slices([t or "" for t in texts], 4_000_000):
        words = state.setdefault("words", Words())
        found = [measure(t, words) for t in run]
        ends, hashes = np.array(words.ends), np.array(words.hashes, np.uint64)
        for m in found:
            yield m, _buckets(m.numbers, ends, hashes, bits)
        if len(words) > REMEMBERED:
            del state["words"]


@dataclass
class Model:
    """Log ratio by bucket, and the least score that is kept."""

    ratio: np.ndarray
    least: float

    @property
    def bits(self) -> int:
        return len(self.ratio).bit_length() - 1

    def score(self, buckets: np.ndarray) -> float:
        return float(self.ratio[buckets].mean()) if len(buckets) else 0.0


def counts(docs: DataFrame, bits: int = BUCKET_BITS, text: str = "text") -> np.ndarray:
    """n-grams of all documents by bucket: summed in each task, then by bucket over the tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, state = np.zeros(1 << bits, np.int64), {}
        for batch in batches:
            for _, buckets in _measured(batch.column(0).to_pylist(), bits, state):
                np.add.at(total, buckets, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["b", "n"])

    rows = arrow_map(only(docs, text), of, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, bits: int = BUCKET_BITS,
    smoothing: float = SMOOTHING, text: str = "text", key: str = "doc_id", label: str = "quality",
) -> Model:
    """Fit the ratio and the threshold.

    `labels` (key, label 1 good or 0 bad; several labels of a key count as the least) gives at
    most `labelled` documents. One half by hash makes the target; the other half's scores give the
    threshold that parts good from bad best, in the middle of the best gap. Without bad documents
    the threshold lies under the least good one; without good ones everything passes.
    """
    chosen = (
        labels.select(F.col(key).alias("k"), F.col(label).alias("good"))
        .filter("k is not null and good in (0, 1)")
        .groupBy("k").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("k"), "k").limit(labelled)
    )
    chosen = keep(chosen, "labels")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "k")  # at most `labelled` ids
    sample = keep(sample.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(2))), "labelled")
    raw = counts(docs, bits, text)
    target = counts(sample.filter("good = 1 and half = 0"), bits)
    if not target.any():
        return Model(np.zeros(1 << bits), -np.inf)
    whole = smoothing * len(raw)
    ratio = np.log((target + smoothing) / (target.sum() + whole)) - np.log((raw + smoothing) / (raw.sum() + whole))
    judged = score(sample.filter("half = 1"), Model(ratio, -np.inf), "text", "good")
    judged = judged.filter("not base_failed").groupBy(F.round(F.col("score") * BIN).alias("bin"), F.col("good"))
    return Model(ratio, _threshold(judged.count().toPandas()) / BIN)


def _threshold(bins) -> float:
    """From rows (bin, good, count): the cut with most good above and most bad below it."""
    if not (bins["good"] == 1).any():
        return -np.inf
    at = np.sort(bins["bin"].unique())
    good, bad = (
        np.array([bins.loc[(bins["good"] == g) & (bins["bin"] == x), "count"].sum() for x in at], float) for g in (1, 0)
    )
    if not bad.any():
        return float(at[good > 0].min()) - 1000.0
    # Cut i keeps bins i and above.
    gain = np.concatenate((np.cumsum(good[::-1])[::-1], [0])) / good.sum() + np.concatenate(([0], np.cumsum(bad))) / bad.sum()
    best = int(np.argmax(gain))
    low = at[best - 1] if best else at[0] - 1
    high = at[best] if best < len(at) else at[-1] + 1
    return float((low + high) / 2)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)
    for every row.

    Null and empty texts have no words and fail the base rules; repeated rows stay repeated; a
    null key is handed on; further columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of buckets
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = shared.value, {}
        for batch in batches:
            rows = []
            for m, buckets in _measured(batch.column(1).to_pylist(), model.bits, state):
                s = model.score(buckets)
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words,
                             m.failed, not m.failed and s >= model.least, s))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=[key, *names, "base_failed", "kept", "score"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names)
    return arrow_map(only(docs, key, text), of, schema + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that pass the base rules and the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = shared.value, {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            good = [not m.failed and model.score(b) >= model.least for m, b in _measured(texts, model.bits, state)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return arrow_map(docs, of, docs.schema)
