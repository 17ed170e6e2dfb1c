"""Token ids in Arrow files: fixed-size lists of equal-length sequences with masks.

Documents are ranged by key, and each task writes one file of its range: record batches of
(ids, mask, pieces). `ids` are fixed-size lists, so that sequence i of a batch is a slice of one
memory-mapped buffer; `mask` are list views as long, and as only the file's last sequence is padded,
all others of a batch view the same bytes. `pieces` says which document's ids lie where. A task writes under a name of its own attempt and reports it in its
row; only files of attempts that succeeded are in the manifest, so lost executors do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_map, hold, keep, only, shared_path
from hazardframe.llm.counts import even

#: Ids of a sequence, sequences of a record batch.
LENGTH, ROWS = 2048, 256
#: Words a worker remembers at most, and words that are learned as one text.
REMEMBERED, LEARNED = 600_000, 200


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path)


class Library:
    """The tokenizers library's ids of whole texts, remembered by stretches that stand alone."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_truncation()
        self.inner.no_padding()
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.inner.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        # Words with the space before them, those of late and those before, and which tokens begin with a space.
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        spaced = [self.inner.id_to_token(i) or "" for i in range(self.inner.get_vocab_size(with_added_tokens=True))]
        self.begins = np.array([t.startswith("Ġ") for t in spaced])

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.inner.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Encode runs of words as texts with a space before each word; a space begins each word's ids."""
        runs = [words[at : at + LEARNED] for at in range(0, len(words), LEARNED)]
        data = b"".join(self._whole([" " + " ".join(run) for run in runs]))
        starts = (np.flatnonzero(self.begins[np.frombuffer(data, self.type)]) * self.type.itemsize).tolist()
        ends = [*starts[1:], len(data)]
        self.seen.update(zip(words, [data[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words; those that are not remembered are learned."""
        seen, before = self.seen, self.before
        found = list(map(seen.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        seen.update([(words[i], before[words[i]]) for i in missing if words[i] in before])
        new = [words[i] for i in missing if words[i] not in seen]
        if new:
            self._learn(new)
        for i in missing:
            found[i] = seen[words[i]]
        if len(seen) > REMEMBERED // 2:  # words of late stay, the older half goes
            self.seen, self.before = {}, seen
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of `type`."""
        # Uneven texts go to the library whole, of the others the first word, which has no space.
        cut = [t.partition(" ") if even(t) and not any(s in t for s in self.special) else (t, "", "") for t in texts]
        out = self._whole([c[0] for c in cut])
        longer = [i for i, c in enumerate(cut) if c[2]]
        if longer:
            lists = pc.split_pattern(pa.array([cut[i][2] for i in longer], pa.large_string()), " ")
            words = lists.flatten().dictionary_encode()
            ids = pa.array(self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
            _, ends, data = ids.buffers()
            ends = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
            data = memoryview(data)
            for i, a, b in zip(longer, ends, ends[1:], strict=False):
                out[i] += data[a:b]
        return out


def library(path: str) -> Library:
    return hold(Library, path)


def file_schema(length: int, ids: pa.DataType, key: pa.DataType) -> pa.Schema:
    piece = pa.struct([("key", key), ("from", pa.int64()), ("length", pa.int64()), ("last", pa.bool_())])
    return pa.schema([
        ("ids", pa.list_(ids, length)), ("mask", pa.list_view(pa.uint8())), ("pieces", pa.list_(piece))])


class Packer:
    """Cuts a stream of documents' ids into sequences and writes them in batches."""

    def __init__(self, sink, schema: pa.Schema, type: np.dtype, length: int, rows: int) -> None:
        self.schema, self.type, self.length, self.rows = schema, type, length, rows
        self.writer = pa.ipc.new_file(sink, schema)
        self.held: list[bytes] = []
        self.size = 0  # ids held
        self.pieces: list[list[dict]] = [[]]
        self.n_docs = self.n_tokens = 0

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // self.type.itemsize
        self.held.append(ids)
        done = 0
        while done < n:
            room = len(self.pieces) * self.length - self.size
            take = min(room, n - done)
            self.pieces[-1].append({"key": key, "from": done, "length": take, "last": done + take == n})
            self.size += take
            done += take
            if self.size == len(self.pieces) * self.length:
                self.pieces.append([])
        self.n_docs += 1
        self.n_tokens += n
        if self.size >= self.rows * self.length:
            self._write(self.size // self.length)

    def _write(self, sequences: int) -> None:
        data = np.frombuffer(b"".join(self.held), self.type)
        full = sequences * self.length
        values = np.zeros(full, self.type)
        values[: min(full, self.size)] = data[:full]
        lists = self.schema.field("ids").type
        for at in range(0, sequences, self.rows):
            n = min(self.rows, sequences - at)
            part = slice(at * self.length, (at + n) * self.length)
            real = np.minimum(self.size - np.arange(at, at + n) * self.length, self.length)  # ids before the padding
            kinds, kind = np.unique(-real, return_inverse=True)  # full sequences first; all of them share one mask
            mask = (np.arange(self.length) < -kinds[:, None]).astype(np.uint8).ravel()  # bytes: a reader needs no copy
            self.writer.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(values[part], lists.value_type), type=lists),
                pa.ListViewArray.from_arrays(
                    pa.array(kind * self.length, pa.int32()), pa.array(np.full(n, self.length), pa.int32()), pa.array(mask)),
                pa.array(self.pieces[at : at + n], self.schema.field("pieces").type)], schema=self.schema))
        rest = data[full:]
        self.held, self.size = ([rest.tobytes()] if len(rest) else []), len(rest)
        self.pieces = self.pieces[sequences:] or [[]]

    def close(self) -> None:
        if self.size:
            self._write(-(-self.size // self.length))
        self.writer.close()


def write(
    docs: DataFrame, path: str, end: int = 0, folder: str | None = None, length: int = LENGTH, rows: int = ROWS,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Write every row's ids and the id `end` in ascending order of key, nulls first, equal keys by
    their texts' hash; null and empty texts have the end id alone.

    Returns the manifest (shard, path, n_docs, n_tokens, base), base being the ids of all shards
    before. An empty table gives no file. `path` is the vocabulary's, there on every executor;
    `folder` is a URI that all executors share, by default below spark.checkpoint.dir.
    """
    folder = folder or shared_path(docs.sparkSession, "arrow")
    kind = pa_type(docs, key)
    hashed = only(docs, key, text).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    ranged = hashed.repartitionByRange("key", "h").sortWithinPartitions("key", "h")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, out = library(path), None, None
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        tail = np.array([end], coder.type).tobytes()
        ids = pa.uint16() if coder.type.itemsize == 2 else pa.uint32()
        for batch in batches:
            if packer is None:
                fs, inner = place(name)
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(inner, compression=None)
                packer = Packer(out, file_schema(length, ids, kind), coder.type, length, rows)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = coder.encode([t or "" for t in part.column(1).to_pylist()])
                for k, x in zip(part.column(0).to_pylist(), found, strict=True):
                    packer.add(k, x + tail)
        if packer is not None:
            packer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [name], "n_docs": [packer.n_docs], "n_tokens": [packer.n_tokens]})

    manifest = keep(arrow_map(ranged, of, "shard long, path string, n_docs long, n_tokens long", holding=True), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return keep(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def pa_type(docs: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader; a local file is mapped, so that batches are views of it."""
    fs, inner = place(path)
    source = pa.memory_map(inner) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(inner)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file: ids and mask, both views of it. All batches but the last are full."""
    batch = reader.get_batch(i // rows)
    length = batch.schema.field("ids").type.list_size
    at = i % rows
    masks = batch.column("mask")
    mask = masks.values.slice(masks.offsets[at].as_py(), length)
    return batch.column("ids").values.slice(at * length, length).to_numpy(), mask.to_numpy()


def read_documents(spark: SparkSession, manifest: DataFrame, kind: str = "bigint", key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files, file by file."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from _documents(open_file(path), base, key)

    files = max(1, manifest.count())
    dealt = manifest.select("path", "base").repartition(files)
    return arrow_map(dealt, of, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def _documents(reader: pa.ipc.RecordBatchFileReader, start: int, key: str) -> Iterator[pa.RecordBatch]:
    type = next(f.type for f in reader.schema.field("pieces").type.value_type if f.name == "key")
    crc = size = 0
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids = batch.column("ids").values.to_numpy()
        pieces = batch.column("pieces")
        length = batch.schema.field("ids").type.list_size
        flat = pieces.values
        owner = np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy()))
        keys, lengths, lasts = (flat.field(n).to_pylist() for n in ("key", "length", "last"))
        rows = []
        at, previous = 0, -1
        for o, k, n, last in zip(owner.tolist(), keys, lengths, lasts, strict=True):
            at = o * length if o != previous else at
            previous = o
            crc = zlib.crc32(ids[at : at + n].astype("<u4").tobytes(), crc)
            at += n
            size += n
            if last:
                rows.append((k, start, size, crc))
                start += size
                crc = size = 0
        if rows:
            k, s, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, type), *(pa.array(x, pa.int64()) for x in (s, n, c))],
                names=[key, "start", "n_tokens", "ids_crc32"])
