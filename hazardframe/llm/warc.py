"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each task buffers the first records of a file, builds a dictionary from them, writes it in a
skippable frame at the head and then one frame a record, so that any record can be read by its
offset. Of equal payloads one row is the response and the others revisit it; which is found by an
aggregate over payload digests, without gathering a group. Files carry their attempt's name, and
only those of successful attempts are in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.binary import place
from hazardframe.llm.common import arrow_map, keep, shared_path

#: Head of the frame that holds the dictionary (a skippable frame's number).
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
#: Records' bytes that a dictionary is built from at most, and a file's bytes before compression.
SAMPLE_BYTES, FILE_BYTES = 4 * 1024 * 1024, 512 * 1024 * 1024
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head, or a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url or "urn:none")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


class Archive:
    """One file: a dictionary frame, then a frame for each record."""

    def __init__(self, out, level: int = LEVEL, sample_bytes: int = SAMPLE_BYTES) -> None:
        self.out, self.level, self.sample_bytes = out, level, sample_bytes
        self.held: list[bytes] = []
        self.raw = self.held_bytes = 0
        self.packer: zstd.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.raw += len(data)
        if self.packer is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= self.sample_bytes:
                self._begin()
        else:
            self.out.write(self.packer.compress(data))

    def _begin(self) -> None:
        self.packer = zstd.ZstdCompressor(level=self.level, write_checksum=True)
        samples = [d[i : i + 32_768] for d in self.held for i in range(0, min(len(d), 1 << 20), 32_768)]
        try:
            words = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, f=20, accel=4)
        except zstd.ZstdError:  # too few or too small records
            words = None
        if words is not None:
            words.precompute_compress(level=self.level)
            packed = zstd.ZstdCompressor(level=19).compress(words.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            self.packer = zstd.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True)
        for data in self.held:
            self.out.write(self.packer.compress(data))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.packer is None:
            self._begin()
        self.out.close()


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of each record of an open file; a revisit's payload is empty."""
    head = source.read(8)
    words = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        packed = source.read(struct.unpack("<I", head[4:])[0])
        words = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(packed))
        head = b""
    source.seek(source.tell() - len(head))
    stream = zstd.ZstdDecompressor(dict_data=words).stream_reader(source, read_across_frames=True)
    lines = io.BufferedReader(stream, 1 << 20)
    while first := lines.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError("no WARC record here")
        fields = {}
        while line := lines.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name] = value.strip()
        block = lines.read(int(fields["Content-Length"]))
        lines.read(4)
        yield fields, block.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, url, html, refers_to): of rows with equal payloads of at least `least_bytes` bytes
    all but those of the largest key refer to it; rows of payloads without any key stay responses."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("page"), F.col("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    sizes = rows.select("page", "sha1", F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= least_bytes)
    shared = sizes.groupBy("sha1").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keep(shared.select("sha1", "first"), "payloads")
    met = rows.join(shared, "sha1", "left")
    return met.select("page", "url", "html", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES,
    key: str = "page_id", html: str = "html",
) -> DataFrame:
    """Write a record per row; returns the manifest (path, n_records). `folder` is a URI that all
    executors share. A null html is an empty payload, a null url is urn:none; an empty table gives
    no file; further columns are ignored."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        part = TaskContext.get().partitionId()
        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "html", "refers_to")]
            for row in zip(*columns, strict=True):
                page, url, text, refers = (x.as_py() for x in row)
                if archive is None:
                    name = f"{folder}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst"
                    fs, inner = place(name)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    archive, count = Archive(fs.open_output_stream(inner, compression=None)), 0
                archive.add(record(page, url, text.encode("utf-8", "replace"), refers))
                count += 1
                if archive.raw >= file_bytes:
                    archive.close()
                    done.append((name, count))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": [d[1] for d in done]})

    rows = revisits(pages, least_bytes, key, html)
    return keep(arrow_map(rows, of, "path string, n_records long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload binary) of every record."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def page(field: str | None) -> int | None:
            number = (field or "").removeprefix("<urn:page:").rstrip(">")
            return int(number) if number else None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = place(path)
                rows, size = [], 0
                with fs.open_input_file(inner) as source:
                    for fields, payload in records(source):
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and base32_sha1(payload) != digest:
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                        rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                                     page(fields.get("WARC-Refers-To")), digest, payload if response else None))
                        size += len(payload)
                        if size >= 8_000_000 or len(rows) >= 2000:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    dealt = manifest.select("path").repartition(max(1, manifest.count()))
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
    return arrow_map(dealt, of, schema)
