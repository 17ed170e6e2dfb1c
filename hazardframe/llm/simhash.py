"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are computed per text in Arrow batches. Distinct fingerprints are then spread over
tables of bit blocks: two fingerprints within the radius agree on some choice of whole blocks, so
each linked pair meets in at least one bucket. In a bucket the fingerprints lie as vertical bit
planes, 64 to a machine word; carry-save counters update 64 distances with a few bit operations
per plane, and a word is abandoned once all its 64 distances exceed the radius. A bucket that is
too large is cut into cells of block pairs, so no task ever gets a whole hot bucket; a cell gives
back a spanning forest of its links, not its pairs. Components of the forests are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map, components, keep

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of one bucket that are compared in one cell with those of another such part.
CELL = 2048
#: Queries times words that one step compares at once.
STEP = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        rows = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (key, x, fp) per row; x is the text's hash, fp the fingerprint's 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=[key, "x", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")).alias("x"), F.col(f"`{text}`"))
    return arrow_map(own, of, f"`{key}` {kind}, x long, fp long")


def planes(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of `values`, whose `groups` are sorted numbers from 0.

    Returns the planes (64 x words), and per value its first word, its group's words, and its slot
    (word * 64 + lane). A group starts a new word.
    """
    sizes = np.bincount(groups)
    words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    slot = first[groups] * 64 + (np.arange(len(values)) - begin[groups])
    padded = np.zeros(int(words.sum()) * 64, np.uint64)
    padded[slot] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    sliced = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(sliced).view("<u8")[:, :, 0], first[groups], words[groups], slot


def near(plane: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (word number, query value): which have a lane within `radius`, and these lanes' bits.

    Distances of 64 lanes are held as bits in carry-save counters that start at the distance at
    which one more overflows; `dead` collects lanes beyond the radius.
    """
    width = max(1, (radius + 1).bit_length())
    slack = (1 << width) - 1 - radius
    alive = np.arange(len(word))
    counter = [np.full(len(word), _FULL if slack >> k & 1 else 0, np.uint64) for k in range(width)]
    dead = np.zeros(len(word), np.uint64)
    for bit in range(64):
        own = np.where((query[alive] >> np.uint64(bit)) & np.uint64(1), _FULL, np.uint64(0))
        carry = plane[bit, word[alive]] ^ own
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        dead |= carry
        if bit >= 7 and bit % 4 == 3:
            left = dead != _FULL
            if not left.all():
                alive, dead, counter = alive[left], dead[left], [c[left] for c in counter]
        if not len(alive):
            break
    return alive, ~dead


def forest(groups: np.ndarray, values: np.ndarray, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span the components of equal-group values within the radius.

    `parts` is 0 or 1; a group with both holds two different parts, of which only pairs across
    matter: the pairs inside each are compared in a cell of their own.
    """
    plane, first, words, slot = planes(groups, values)
    lanes = np.zeros(plane.shape[1] * 64, bool)
    lanes[slot] = True
    valid = np.packbits(lanes.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    member = np.full(len(lanes), -1)
    member[slot] = np.arange(len(slot))
    side = np.zeros(len(lanes), bool)
    side[slot] = parts.astype(bool)
    ones = np.packbits(side.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    two = np.zeros(int(groups[-1]) + 1, bool)
    two[groups[parts == 1]] = True
    items = np.repeat(np.arange(len(values)), words)
    offset = np.arange(len(items)) - np.repeat(np.concatenate(([0], np.cumsum(words)[:-1])), words)
    found_q, found_w, found_b = [], [], []
    for at in range(0, len(items), STEP):
        q = items[at : at + STEP]
        w = first[q] + offset[at : at + STEP]
        hit, bits = near(plane, w, values[q], radius)
        q, w = q[hit], w[hit]
        across = np.where(parts[q] == 1, ~ones[w], ones[w])
        bits = bits & valid[w] & np.where(two[groups[q]], across, _FULL)
        own = w == slot[q] >> 6
        bits = np.where(own, bits & ~(np.uint64(1) << (slot[q] & 63).astype(np.uint64)), bits)
        some = bits != 0
        found_q.append(q[some]), found_w.append(w[some]), found_b.append(bits[some])
    q, w, b = np.concatenate(found_q), np.concatenate(found_w), np.concatenate(found_b)
    return _span(q, w, b, member)


def _span(q: np.ndarray, w: np.ndarray, b: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search over rows of match bits; each level is one union of whole words."""
    a, r = [], []
    if not len(q):
        return np.array(a, np.int64), np.array(r, np.int64)
    order = np.argsort(q, kind="stable")
    q, w, b = q[order], w[order], b[order]
    heads, begin = np.unique(q, return_index=True)
    row = dict(zip(heads.tolist(), zip(begin.tolist(), np.append(begin[1:], len(q)).tolist(), strict=True), strict=True))
    done: set[int] = set()
    for seed in heads.tolist():
        if seed in done:
            continue
        done.add(seed)
        level = [seed]
        while level:
            if len(level) == 1:
                s, e = row[level[0]]
                at, bits = w[s:e], b[s:e]
            else:
                at = np.concatenate([w[slice(*row[x])] for x in level])
                bits = np.concatenate([b[slice(*row[x])] for x in level])
                by = np.argsort(at, kind="stable")
                at, cut = np.unique(at[by], return_index=True)
                bits = np.bitwise_or.reduceat(bits[by], cut)
            flags = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(flags)
            level = [x for x in member[at[i] * 64 + lane].tolist() if x not in done]
            done.update(level)
            a += level
            r += [seed] * len(level)
    return np.array(a, np.int64), np.array(r, np.int64)


def layout(count: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that agree): the fewest tables whose keys have at least log2(count) bits."""
    need = max(1, count).bit_length()
    for blocks in range(radius + 1, 65):
        agree = blocks - radius
        if agree * 64 // blocks >= min(need, 40):
            return blocks, agree
    return 64, 64 - radius


def links(values: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints `fp` at most `radius` bits apart."""
    blocks, agree = layout(values.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    rows = values.select("fp", tables.alias("t", "key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = keep(sizes, "buckets")
    # A bucket of n members has k = ceil(n / cell) parts; part p meets every part, itself included.
    parts = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("k")).cast("int")
    cells = (
        rows.join(sizes, ["t", "key"])
        .withColumn("k", parts).withColumn("p", part)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("fp", "t", "key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"),
                F.when(F.col("p") <= F.col("o"), 0).otherwise(1).alias("side"))
    )
    spread = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            keys = [table.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            fp = table.column("fp").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            a, r = forest(np.cumsum(new), fp, side, radius)
            out = [pa.array(fp[x].view(np.int64)) for x in (a, r)]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b"])

    return arrow_map(spread, compare, "a long, b long")


def _whole_cells(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Runs of sorted rows that end where a cell ends, so that none is cut."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(c)[-1].as_py() for c in ("t", "key", "i", "j")]
        same = np.ones(table.num_rows, bool)
        for c, v in zip(("t", "key", "i", "j"), last, strict=True):
            same &= table.column(c).to_numpy() == v
        cut = table.num_rows - int(same.sum())
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks().to_batches()
        count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _placed(docs: DataFrame, radius: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, x, fp) of every row, and (fp, first, component) of every fingerprint: `first` is its
    row of least key, null last, then of least text hash."""
    prints = keep(fingerprints(docs, text, key), "fingerprints")
    first = F.min(F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("least"), "x"))
    values = keep(prints.groupBy("fp").agg(first.alias("first")), "values")
    groups = components(links(values.select("fp"), radius), "simhash")
    placed = values.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, keep(placed.select("fp", "first", F.coalesce("component", "fp").alias("component")), "placed")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for every row: rows whose fingerprints are linked, directly or by a
    chain, have the same component_id, the least non-null key among them.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A row without a key gets its component's least key, null if no member has one.
    Further columns are ignored. An empty table gives an empty result.
    """
    prints, placed = _placed(docs, radius, text, key)
    heads = keep(placed.groupBy("component").agg(F.min("first.least").alias("component_id")), "heads")
    named = keep(placed.join(heads, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of `docs`, all columns, of each group: that of its least key, of repeats any one.
    Rows without a key stay only where their whole group has none, one of them.

    A row is known by its key and its text's hash, so a key that several texts share, null
    included, stands for each of their groups. Further columns of any name stay as they are. An
    empty table gives an empty result."""
    hashed = "text_hash"
    while hashed in docs.columns:
        hashed += "_"
    _, placed = _placed(docs, radius, text, key)
    heads = placed.groupBy("component").agg(F.min("first").alias("first"))
    heads = keep(heads.select(F.col("first.least").alias("head"), F.col("first.x").alias("head_x")).distinct(), "heads")
    heads = heads.toDF("__head", "__head_x")
    rows = docs.withColumn(hashed, F.xxhash64(F.col(text)))
    kept = rows.join(heads, rows[key].eqNullSafe(heads["__head"]) & (rows[hashed] == heads["__head_x"]), "left_semi")
    return kept.dropDuplicates([key, hashed]).drop(hashed)
