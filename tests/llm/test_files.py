"""Arrow and WARC files: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from hazardframe.llm import binary, queries, warc

DATA = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files_query(spark):
    lib = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for d in docs:
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op9_token_files"](spark, DATA).collect())) == want


def test_token_files_odd_rows(spark):
    rows = [(3, "b  c<|endoftext|>d"), (1, None), (2, ""), (None, "x"), (3, "a " * 3000), (3, "a " * 3000), (5, "é\n\n z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base long")
    manifest = binary.write(df, BYTES, end=7, length=16, rows=4)
    got = binary.read_documents(spark, manifest).collect()
    lib = Tokenizer.from_file(BYTES)
    want = sorted((len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows))
    assert sorted(r.n_tokens for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 3, 3, 5]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    first = manifest.orderBy("shard").first()
    reader = binary.open_file(first.path)
    ids, mask = binary.sequence(reader, 0, rows=4)
    assert len(ids) == 16 and ids[:2].tolist() == [lib.encode("x").ids[0], 7] and mask[0]
    for got_, name in ((ids, "ids"), (mask, "mask")):  # views of the mapped file, no copies
        assert got_.__array_interface__["data"][0] == reader.get_batch(0).column(name).values.buffers()[1].address
    assert binary.read_documents(spark, binary.write(df.limit(0), BYTES)).count() == 0


def test_masks_of_full_sequences_lie_in_a_file_once(tmp_path):
    schema = binary.file_schema(16, pa.uint16(), pa.int64())
    with open(tmp_path / "x.arrow", "wb") as f:
        packer = binary.Packer(f, schema, np.dtype("<u2"), 16, 4)
        for key in range(9):
            packer.add(key, np.arange(10, dtype="<u2").tobytes())
        packer.close()
    reader = binary.open_file(f"file://{tmp_path}/x.arrow")
    found = [binary.sequence(reader, i, rows=4) for i in range(6)]
    assert [mask.sum() for _, mask in found] == [16] * 5 + [10] and all(len(mask) == 16 for _, mask in found)
    assert np.concatenate([ids[mask == 1] for ids, mask in found]).tolist() == [*range(10)] * 9
    assert [len(reader.get_batch(b).column("mask").values) for b in range(2)] == [16, 32]


def test_words_of_late_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(binary, "REMEMBERED", 40)
    lib, coder, learned = Tokenizer.from_file(BYTES), binary.Library(BYTES), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda words: (learned.extend(words), learn(words)))
    for i in range(30):
        text = "a common word, " + " ".join(f"w{i}x{j}" for j in range(7))
        (ids,) = coder.encode([text])
        assert np.frombuffer(ids, coder.type).tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(coder.seen) <= 40 // 2 and len(coder.before) <= 40 // 2 + 9
    assert learned.count("common") == 1 and len(learned) == 2 + 30 * 7


def plain_warc(rows):
    best = {}
    for page, html in rows:
        p = (html or "").encode()
        if page is not None:
            best[p] = max(page, best.get(p, page))
    out = []
    for page, html in rows:
        p = (html or "").encode()
        r = best.get(p)
        revisit = r is not None and page != r
        out.append((page, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=repr)


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = queries.QUERIES["op5_warc_round_trip"](spark, DATA).collect()
    assert sorted(map(tuple, got), key=repr) == plain_warc(rows)


def test_warc_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/ b\r\n", "<p>x"), (2, None, "<p>x"), (2, "u", "<p>x"), (None, "u", "<p>x"), (5, "u", None),
            (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 9), (None, "u", "alone"), (8, "é", "y" * 400_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op5_warc_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_warc([(p, h) for p, _, h in rows])
    manifest = warc.write(pages.repartition(1), file_bytes=1000)
    assert manifest.count() > 1
    payloads = {r.page_id: r.payload for r in warc.read(manifest).collect() if r.record_type == "response"}
    assert payloads[7].decode() == rows[6][2] and payloads[8].decode() == rows[8][2]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_dictionary_is_embedded_and_records_stand_alone(tmp_path):
    import zstandard

    name = tmp_path / "x.warc.zst"
    archive = warc.Archive(open(name, "wb"), sample_bytes=200_000)
    body = [f"<html>{i} shared boilerplate of every page, menu, footer {i * 7919}</html>".encode() * 5 for i in range(2000)]
    for i, b in enumerate(body):
        archive.add(warc.record(i, f"http://h/{i}", b, None))
    archive.close()
    data = name.read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: response") and one.eof
    with open(name, "rb") as f:
        assert [p for _, p in warc.records(f)] == body
