"""Near-duplicate documents by Jaccard similarity of word shingles, joined by vertical partitions.

Every distinct shingle is a number of a global order: a level, which is higher for shingles that
stand in unusually many documents, then its hash. Equal sets are one class. Two classes of share t
or more have a shingle in common among the first numbers of each set (their prefixes), so only
classes that meet there are compared. A comparison is cut vertically: the order is cut into fragments,
each set into the same fragments, the overlap of a pair is counted in each fragment on its own, and the
counts are summed per pair.

Groups of near copies would give pairs by the square of their size. They need not: what is asked are
components, so members of one component are not compared. In rounds, each class is
compared with one leader among the classes it meets and that lie in another component; links
found merge components. When the meetings across components that are left are few against the
postings, or a round does not halve them any more, all pairs that still meet are compared, those
apart whose overlap in the prefixes or whose parity bits show that they cannot reach the share.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map, components, keep, slices

SHINGLE = 5
#: Linked are sets whose overlap has at least this percentage of their union.
SHARE = 80
#: Bits of a shingle's hash; the level stands above them, the fragments are cut by bits below the level.
HASH_BITS, FRAGMENT_BITS = 60, 3
#: Shingles a bucket of the frequency table is made for, the most buckets and the parts they travel in, as powers of two.
BUCKET, MOST_BUCKET_BITS, PART_BITS = 256, 20, 6
#: Rows, and shingles, up to which a counted table is broadcast.
SMALL_ROWS, SMALL_SHINGLES = 300_000, 1_000_000
#: Meetings across components, in postings, that are looked at without a further round of leaders.
FEW = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word: 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of fewer words the whole sequence is one."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words)) >> 4], np.uint64)
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(word) - size + 1
    h = word[:n] * _MIX
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(32))) * _MIX + word[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    h >>= np.uint64(64 - HASH_BITS)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers in the global order, ascending."""
    bits = len(levels).bit_length() - 1
    level = levels[(h >> np.uint64(HASH_BITS - bits)).astype(np.int64)].astype(np.uint64)
    return np.sort(h | level << np.uint64(HASH_BITS)) if level.any() else h


def frequency_levels(docs: DataFrame, text: str) -> np.ndarray:
    """Per bucket of shingle hashes its level: k where it has 2^k times the mean or more.

    All documents count. Any levels give the same result; they only keep frequent shingles out of
    prefixes. A task's counts travel as arrays, one per part of the buckets.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    bits = min(max(size // 6 // BUCKET, 1 << PART_BITS).bit_length(), MOST_BUCKET_BITS)
    shift = np.uint64(HASH_BITS - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for run in slices([t.as_py() or b"" for t in batch.column(0)], 2_000_000):
                found = np.concatenate([shingles(t, hashes) for t in run])
                total += np.bincount((found >> shift).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(1 << PART_BITS, -1)
        yield _parts(np.arange(len(parts)), [p.tobytes() for p in parts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*batch.columns, strict=True):
                sums[part.as_py()] = sums.get(part.as_py(), 0) + np.frombuffer(data.as_py(), np.int64)
        yield _parts(list(sums), [x.tobytes() for x in sums.values()])

    rows = arrow_map(docs.select(F.col(f"`{text}`").cast("binary")), count, "part int, counts binary").repartition("part")
    total = np.zeros((1 << PART_BITS, 1 << bits - PART_BITS), np.int64)
    for row in arrow_map(rows, add, "part int, counts binary").collect():  # 2^20 counts together at most
        total[row.part] = np.frombuffer(row.counts, np.int64)
    share = total.ravel() / max(1.0, total.mean())
    return np.clip(np.floor(np.log2(np.maximum(share, 1.0))), 0, 7).astype(np.uint8)


def _parts(parts, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], names=["part", "counts"])


def prefix(n: int) -> int:
    """How many first numbers of a set of n meet those of every linked set."""
    return n - -(-SHARE * n // 100) + 1


def sets(docs: DataFrame, levels: np.ndarray, text: str, key: str) -> DataFrame:
    """(key, x, n, node, prefix, bits) per row: its text's hash, its set's size, hash, first numbers and
    parity bits.

    Sets are told apart by 64 bits; for 10^8 different ones, a chance of 3 in 10 000 that any two are
    taken for equal.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sizes, nodes, firsts, bits = [], [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py(), hashes)
                sizes.append(len(h))
                nodes.append(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64) if len(h) else None)
                firsts.append(ordered(h, levels)[: prefix(len(h))].astype(np.int64) if len(h) else h.astype(np.int64))
                bits.append(parity(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), _lists(firsts), _lists(bits)],
                names=[key, "x", "n", "node", "prefix", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`"), _text_hash(text), F.col(f"`{text}`").cast("binary"))
    return arrow_map(own, of, f"`{key}` {kind}, x long, n int, node long, prefix array<long>, bits array<long>")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def parity(h: np.ndarray) -> np.ndarray:
    """For each value of the low bits whether it is that of an odd number of shingles; two to four bits
    a shingle, whole words. Bits in which two sets differ are never more than shingles only one of them has."""
    size = max(64, 1 << max(2 * len(h) - 1, 1).bit_length())
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`")).alias("x")


def fragments(docs: DataFrame, heads: DataFrame, levels: np.ndarray, text: str, key: str) -> DataFrame:
    """(node, v, numbers) of the classes in `heads` (node, head, x): each set's numbers in fragment v
    of the global order. The classes' texts are read anew, each from its head's row."""
    rows = docs.select(F.col(f"`{key}`").alias("head"), _text_hash(text), F.col(f"`{text}`").cast("binary").alias("text"))
    heads = heads.toDF("node", "own", "y")
    rows = rows.join(_small(heads), rows["head"].eqNullSafe(heads["own"]) & (rows["x"] == heads["y"])).select("node", "text")
    shift = np.uint64(HASH_BITS - FRAGMENT_BITS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            nodes, names, sizes, parts = [], [], [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = ordered(shingles(t.as_py(), hashes), levels)
                v, first, count = np.unique(numbers >> shift, return_index=True, return_counts=True)
                nodes += [node] * len(v)
                names += v.tolist()
                sizes += count.tolist()
                parts.append(numbers)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(names, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["node", "v", "numbers"])

    return arrow_map(rows, of, "node long, v int, numbers array<long>")


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if it is small, after counting it."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def differing(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The kept `pairs` whose parity bits (node, bits) do not differ in too many places."""
    a = bits.toDF("a", "mine")
    b = bits.toDF("b", "others")
    both = pairs.join(a, "a").join(b, "b")

    def folded(one: str, other: str) -> Column:
        # Of two sizes the larger is folded upon the smaller; they differ by one doubling at most.
        half = F.size(other)
        halves = F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(one) > half, halves).otherwise(F.col(one))

    differ = F.zip_with(folded("mine", "others"), folded("others", "mine"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.aggregate(differ, F.lit(0), lambda x, y: x + y)
    few = total * (100 + SHARE) <= (100 - SHARE) * (F.col("na") + F.col("nb"))
    return both.filter(few).select("a", "na", "b", "nb")


def linked(pairs: DataFrame, bits: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) of the kept `pairs` that are similar enough: overlaps are counted in each fragment of
    the order, then summed. `read` gives the fragments of the classes in a table (node)."""
    pairs = keep(differing(pairs, bits), "near-pairs")
    count = pairs.count()
    parts = keep(read(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "fragments")
    one = parts.join(_small(pairs.select("a", "b"), count), F.col("a") == F.col("node")).select("a", "b", "v", F.col("numbers").alias("mine"))
    partners = pairs.groupBy("b").agg(F.first("nb").alias("nb"))
    size = partners.agg(F.sum("nb"), F.count("b")).first()
    other = parts.join(_small(partners.select("b"), size[1]), F.col("b") == F.col("node"), "left_semi").toDF("b", "v", "numbers")
    if (size[0] or 0) <= SMALL_SHINGLES:
        other = F.broadcast(other)
    common = F.size(F.array_intersect("mine", "numbers"))
    # Rows that are repeated as a whole give their class's fragments twice.
    partial = one.join(other, ["b", "v"]).groupBy("a", "b", "v").agg(F.max(common).alias("o"))
    total = partial.groupBy("a", "b").agg(F.sum("o").alias("o")).join(_small(pairs, count), ["a", "b"])
    return total.filter(F.col("o") * (100 + SHARE) >= SHARE * (F.col("na") + F.col("nb"))).select("a", "b")


def _similar_sizes(one: str, other: str) -> Column:
    return F.least(F.col(one), F.col(other)) * 100 >= F.greatest(F.col(one), F.col(other)) * SHARE


def meetings(rows: DataFrame) -> DataFrame:
    """(token, node, n, pos): the postings of prefix numbers in which at least two classes meet.

    Postings are dealt by number and sorted, and each is compared with its neighbours only; repeated
    ones of a class count once.
    """
    postings = rows.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "n", "pos")
    return arrow_map(
        postings.repartition("token").sortWithinPartitions("token", "node"), shared, "token long, node long, n int, pos int")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings those whose number another class has, one per class."""
    held, given = None, True  # the last posting, and whether it has been given out
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(([h], c)) for h, c in zip(held, columns, strict=True)]
        token, node = columns[:2]
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        columns = [c[new] for c in columns]
        token = columns[0]
        same = token[1:] == token[:-1]
        keeps = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if held is not None and given:
            keeps[0] = False
        given_last = bool(keeps[-1]) or held is not None and given and len(token) == 1
        held, given = [c[-1] for c in columns], given_last
        yield pa.RecordBatch.from_arrays([pa.array(c[keeps], f.type) for c, f in zip(columns, batch.schema, strict=True)], schema=batch.schema)


def _placed(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Postings with the component of their class."""
    if groups is None:
        return met.withColumn("comp", F.col("node"))
    groups = groups.toDF("node", "component")
    return met.join(_small(groups), "node", "left").select(
        "token", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))


def component_links(met: DataFrame, bits: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Links (a, b) whose components are those of all linked pairs of classes; None without any."""
    postings = met.count()
    central = met.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    central = keep(central.select("node", F.floor(F.col("c") * -1000 / F.col("n")).alias("c")), "central")
    found: list[DataFrame] = []
    groups, turn, before = None, 0, math.inf
    while postings:
        rows = keep(_placed(met, groups), "placed")
        # The first leader is the class whose shingles most others have, later ones go by chance.
        first = F.col("c") if turn == 0 else F.lit(0)
        ranked = rows.join(_small(central), "node") if turn == 0 else rows
        leader = F.struct(first.alias("c"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n")
        by_comp = ranked.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"), F.min(leader).alias("best"))
        best = F.struct("best", "comp")
        tokens = by_comp.groupBy("token").agg(
            F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.min(best).alias("one"), F.max(best).alias("other"))
        open_ = keep(tokens.filter("one.comp <> other.comp"), "open")
        across = open_.agg(F.sum(F.expr("cast(m * m - squares as double) / 2"))).first()[0] or 0
        if not across:
            break
        last = turn > 0 and (across <= FEW * postings or across > before / 2)
        if last:
            pairs = _across(rows, open_)
        else:
            pick = F.when(F.col("comp") != F.col("one.comp"), F.col("one.best")).otherwise(F.col("other.best"))
            picked = rows.join(open_, "token").select("node", "n", pick.alias("p")).select("node", "n", "p", F.col("p.n").alias("np"))
            picked = picked.filter(_similar_sizes("n", "np")).groupBy("node", "n").agg(F.min("p").alias("p"))
            pairs = picked.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("p.node").alias("b"), F.col("p.n").alias("nb"))
        links = keep(linked(keep(pairs, "pairs"), bits, read), "links")
        some = not links.isEmpty()
        if some:
            found.append(links)
        if last:
            break
        if some:
            groups = components(reduce(DataFrame.unionAll, found), "jaccard")
        turn, before = turn + 1, across
        release(met.sparkSession)
    return reduce(DataFrame.unionAll, found) if found else None


def _across(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Every pair across components that sizes, places and overlap of the prefixes do not rule out."""
    rows = rows.join(open_.select("token"), "token")
    one = rows.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    other = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    first = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    meet = one.join(other, "token").filter((F.col("ca") != F.col("cb")) & first & _similar_sizes("na", "nb"))
    # At the first common number, no more than the rest of the shorter tail can be common; and what is
    # common beyond the prefixes is no more than the longer rest.
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = SHARE * (F.col("na") + F.col("nb"))
    counted = meet.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c"), F.max(left).alias("left"))
    rest = F.expr(f"greatest(ceil({SHARE} * na / 100), ceil({SHARE} * nb / 100)) - 1")
    fits = (F.col("left") * (100 + SHARE) >= need) & ((F.col("c") + rest) * (100 + SHARE) >= need)
    return counted.filter(fits).select("a", "na", "b", "nb")


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished steps, whose results are kept as tables."""
    gc.collect()
    spark._jvm.System.gc()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) per row: rows whose shingle sets are linked, directly or by a
    chain, have one component_id, the least key among them.

    Null, empty and blank texts have no shingle, are linked with nothing and keep their own key.
    Rows without a key take their component's least key, null where no member has one; repeated rows
    stay repeated. Further columns are ignored. An empty table gives an empty result.
    """
    levels = frequency_levels(docs, text)
    rows = keep(sets(docs, levels, text, key), "sets")
    own = F.struct(F.col(f"`{key}`").isNull().alias("unknown"), F.col(f"`{key}`").alias("key"), "x")
    heads = rows.filter("n > 0").groupBy("node").agg(F.min(own).alias("head"))
    classes = keep(heads.select("node", F.col("head.key").alias("head"), "head.x"), "heads")
    small = _small(classes.toDF("node", "head", "y"))
    of_heads = rows.join(small, (rows["node"] == small["node"]) & rows[key].eqNullSafe(small["head"]) & (rows["x"] == small["y"]), "left_semi")
    met = keep(meetings(of_heads), "meetings")
    bits = met.select("node").distinct().join(of_heads.select("node", "bits").dropDuplicates(["node"]), "node")
    bits = keep(bits, "bits")
    release(docs.sparkSession)

    def read(nodes: DataFrame) -> DataFrame:
        return fragments(docs, keep(classes.join(_small(nodes), "node"), "to-read"), levels, text, key)

    links = component_links(met, bits, read)
    named = classes.select("node", "head")
    if links is None:
        named = named.withColumn("comp", F.col("node"))
    else:
        groups = components(links, "jaccard").toDF("node", "component")
        named = named.join(_small(groups), "node", "left").select("node", "head", F.coalesce("component", "node").alias("comp"))
    named = keep(named, "named")
    least = keep(named.groupBy("comp").agg(F.min("head").alias("component_id")), "least")
    named = keep(named.join(_small(least), "comp").select("node", "component_id"), "components")
    result = rows.join(_small(named), "node", "left")
    return result.select(
        F.col(f"`{key}`"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col(f"`{key}`")).otherwise(F.col("component_id")).alias("component_id"))
