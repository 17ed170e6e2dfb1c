"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that no earlier batch has shown lie end to end in one numpy array of
symbols. In every round each pre-token's lowest-rank pair is merged wherever it stands in that
pre-token, in all pre-tokens at once; pre-tokens without a mergeable pair leave. What is left of
each is its number of tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazardframe.llm.bpe import byte_letters
from hazardframe.llm.common import arrow_map, hold, only, slices

#: Distinct stretches of text a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 600_000
#: The pre-tokens of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Where a space doesn't stand alone between two words, the cut at spaces isn't safe.
_UNEVEN = re.compile(r" \s|\s |^\s|\s$")
_NONE = np.int64(1) << 40


_PIECES = regex.compile(PATTERN)


#: White space other than the space and the line feed.
_RARE_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def even(text: str) -> bool:
    """Whether every space of a text stands alone between two words."""
    if not text or text[0].isspace() or text[-1].isspace():
        return not text
    if "  " in text or " \n" in text or "\n " in text:
        return False
    return not (_RARE_SPACE.search(text) and _UNEVEN.search(text))


def stretches(text: str) -> list[str]:
    """Stretches of a text without special tokens that are cut alike whatever stands around them:
    words with the space before them or, where white space is uneven, the pre-tokens."""
    if not text:
        return []
    if not even(text):
        return _PIECES.findall(text)
    head, *rest = text.split(" ")
    return [head, *[" " + r for r in rest]]


class ByteBpe:
    """Counts of a byte-level vocabulary without normaliser, from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None
        self.seen: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece when no pair can be merged."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = sizes.copy()
        symbols = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = _NONE
            # The least rank of each piece; a piece's last symbol starts no pair.
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            padded = np.append(rank, _NONE)
            least = np.minimum.reduceat(padded, first)
            spread = np.repeat(least, np.diff(np.append(first, len(owner))))
            flag = (padded == spread) & (spread < _NONE)
            at = np.flatnonzero(flag)
            if not len(at):
                break
            # Of overlapping pairs (a run of one symbol) every other one is merged, from the left.
            start = np.concatenate(([True], np.diff(at) != 1))
            head = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
            at = at[(at - head) % 2 == 0]
            symbols[at] = self.made[padded[at]]
            out -= np.bincount(owner[at], minlength=len(out))
            stay = np.repeat(least < _NONE, np.diff(np.append(first, len(owner))))
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out

    def count(self, texts: list[str]) -> list[int]:
        plain, extra = [], []
        for t in texts:
            parts = self.cut.split(t) if self.cut else [t]
            plain.append(list(chain.from_iterable(stretches(p) for p in parts)))
            extra.append(len(parts) - 1)
        new = list(set(chain.from_iterable(plain)).difference(self.seen))
        if new:
            pieces = [_PIECES.findall(s) for s in new]
            flat = [p.encode("utf-8", "replace") for p in chain.from_iterable(pieces)]
            whole = np.cumsum(np.append(0, self.lengths(flat)))
            ends = np.cumsum([0, *map(len, pieces)])
            self.seen.update(zip(new, np.diff(whole[ends]).tolist(), strict=True))
        seen = self.seen
        found = [e + sum([seen[s] for s in p]) for p, e in zip(plain, extra, strict=True)]
        if len(seen) > REMEMBERED:
            seen.clear()
        return found


def byte_bpe(path: str) -> ByteBpe:
    return hold(ByteBpe, path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row.

    Null and empty texts have no bytes and no tokens; a special token's string counts as that one
    token; repeated rows stay repeated; further columns are ignored. The vocabulary file must lie
    at `path` on every executor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.array([n for run in slices(texts, 2_000_000) for n in bpe.count(run)], np.int64)
            sizes = np.array([len(t.encode("utf-8", "replace")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return arrow_map(only(docs, key, text), of, schema, holding=True)
