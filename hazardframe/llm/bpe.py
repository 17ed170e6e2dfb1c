"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols lie in the leaves' order; leaf i holds the rank of the pair that starts at
symbol i, inner nodes hold minima of (rank, place), so the root names the leftmost pair of lowest
rank. A merge updates three leaves and their ancestors. Texts are cut at white space first and
words are remembered within a worker, up to a bound, so that each is merged once.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazardframe.llm.common import arrow_map, hold, only

#: Distinct words a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 800_000
_NONE = 1 << 62
#: White space for Python's split that the vocabulary's pattern takes as marks.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merge(symbols: list[int], rank_of: Callable[[int, int], int | None], made: list[int]) -> list[int]:
    """Merge `symbols` until no adjacent pair has a rank; made[rank] is the merged symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(symbols[i], symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right
    symbols = list(symbols)

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            least = left if left <= right else right
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] < _NONE:
        rank, i = divmod(tree[1], size)
        j = after[i]
        symbols[i], symbols[j] = made[rank], -1
        k = after[i] = after[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            r = rank_of(symbols[i], symbols[k])
            put(i, _NONE if r is None else r * size + i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            r = rank_of(symbols[h], symbols[i])
            put(h, _NONE if r is None else r * size + h)
    return [s for s in symbols if s >= 0]


class _Words(dict):
    """Words with their ids, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.make(word)
        return ids


class WordBpe:
    """Encoder and decoder of a lower-casing vocabulary with word ends, from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((vocab[a] << 20) | vocab[b], rank)
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inside = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
            self.special[t["content"]] = array("I", [t["id"]]).tobytes()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.words = _Words(self._word)

    def _rank(self, a: int, b: int) -> int | None:
        return self.ranks.get((a << 20) | b)

    def _word(self, word: str) -> bytes:
        """Ids, as bytes, of a stretch of text without white space."""
        clean = unicodedata.normalize("NFC", word)
        if "Σ" in clean:  # lower-casing goes letter by letter, without the final form
            clean = clean.replace("Σ", "σ")
        out = array("I")
        for piece in self.pieces.findall(clean.lower()):
            raw = piece.encode("utf-8", "replace")
            symbols = [self.inside[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            out.extend(merge(symbols, self._rank, self.made))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' strings become theirs."""
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return self._plain(text)
        return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        split = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        words = self.words
        out = b"".join([words[w] for w in split])
        if len(words) > REMEMBERED:
            words.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between two: the vocabulary names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def word_bpe(path: str) -> WordBpe:
    return hold(WordBpe, path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = True) -> DataFrame:
    """(key, ids array<int>, decoded string) for every row; `decoded` False leaves the last out.

    Null and empty texts have no ids and decode to the empty string; repeated rows stay repeated;
    further columns are ignored. The vocabulary file must lie at `path` on every executor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [part.column(0), lists]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(only(docs, key, text), of, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded, holding=True)


def _digest(bpe: WordBpe, ids: bytes) -> tuple[int, str, str]:
    back = bpe.decode(ids).encode("utf-8", "replace")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row: as `encode`, with the ids and
    the decoded text left in the task that made them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows = [_digest(bpe, bpe.encode(t.as_py() or "")) for t in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(only(docs, key, text), of, schema, holding=True)
