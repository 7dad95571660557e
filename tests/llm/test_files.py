import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.common import shared_folder
from quarry.llm.files import create, mapped
from quarry.llm.queries import op7_token_files
from quarry.llm.tokenfile import Encoder, read_token_files, write_token_files
from quarry.llm import warc
from quarry.llm.warc import coalesced, read_records, round_trip, write_archives

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "the", "'s", "'", "l", " ", " ", "  ", "\n", "\t", "1", "!", "é", "漢", "😀", "　", "\x85", "\x1f", "​", "<|endoftext|>", "Ñ", "x" * 120]), max_size=40).map("".join), max_size=3))
def test_pieces_equal_whole_text(texts):
    got = [x.tolist() for x in ENCODER.encode(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    rows = [(i, "word " * (i % 7) + f"n{i}\n\n x", "c") for i in range(300, 0, -1)] + [(1000, None, None), (1001, "", ""), (None, "lost", ""), (5, "again", ""), (-3, "y" * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = shared_folder(spark)
    manifest = write_token_files(df, folder, PATH, end_id=0).collect()
    got = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows) - 1 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    start = 0
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r.start == start and list(r.ids) in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert sum(m.n_ids for m in manifest) == start
    first = min(manifest, key=lambda m: m.first_doc)
    assert mapped(f"{first.name}.ends", "<i8")[0] == 0 and mapped(f"{first.name}.docs", "<i8")[0] == -3
    empty = shared_folder(spark)
    write_token_files(df.limit(0), empty, PATH)
    assert read_token_files(spark, empty).count() == 0


def test_special_tokens_as_in_the_library(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain words here", "x <|endoftext|> y\n\n<|endoftext|>.", "", None, "  odd <|endoftext|", "<|endoftext|><|endoftext|> z"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op7_token_files(spark, str(tmp_path)).collect())
    assert [(x.n_tokens, x.ids_crc32) for x in got] == [(len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for w in want]
    assert [x.start for x in got] == [sum(len(w) + 1 for w in want[:i]) for i in range(len(want))]


def test_coalesced():
    assert list(coalesced([(0, 10), (10, 5), (100, 1)], gap=20, most=1000)) == [(0, 15, [0, 1]), (100, 1, [2])]
    assert list(coalesced([(0, 10), (10, 10), (20, 10)], gap=0, most=20)) == [(0, 20, [0, 1]), (20, 10, [2])]
    assert list(coalesced([])) == []


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx", big, 0), (2, None, big, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "small", 0), (6, "u", "small", 0), (7, "u", big, 0), (None, "u", big, 0), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 100_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    index = write_archives(df, shared_folder(spark), 1000)
    got = {r.page_id: r for r in read_records(index, with_payload=True).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    for i, _, html, _ in rows:
        if i is None:
            continue
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 7) if i in (1, 2) else ("response", None))
        assert got[i].payload is None if i in (1, 2) else bytes(got[i].payload) == data
    some = read_records(index.where("page_id IN (3, 8)")).collect()
    assert sorted(r.page_id for r in some) == [3, 8]
    assert read_records(write_archives(df.limit(0), shared_folder(spark))).count() == 0


def test_warc_measures_what_it_reads(spark):
    sha = lambda x: hashlib.sha1(x).hexdigest()

    def stored(*records):
        folder, at, data = shared_folder(spark), 0, b""
        rows = []
        for page, kind, digest, payload in records:
            member = warc._member(warc._record({"page_id": page, "url": "u", "refers_to": kind, "payload_digest": digest}, payload), 1)
            rows.append((f"{folder}/x.warc.gz", at, len(member)))
            at, data = at + len(member), data + member
        with create(f"{folder}/x.warc.gz") as f:
            f.write(data)
        return warc.resolved(read_records(spark.createDataFrame(rows, "file string, offset long, length long")))

    good = stored((1, None, sha(b"body"), b"body"), (2, 1, sha(b"body"), b"body")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in good) == [(1, 4, None), (2, 4, 1)]
    for spoilt in ([(1, None, sha(b"body"), b"bodx")], [(1, None, sha(b"body"), b"body"), (2, 1, sha(b"other"), b"other")], [(2, 1, sha(b"body"), b"body")]):
        with pytest.raises(Exception, match="payload|no response"):
            stored(*spoilt).collect()


def test_warc_repeated_ids_and_hot_payloads(spark, monkeypatch):
    big, other = "é" * 600, "x" * 2000
    rows = [(5, "a", big), (5, "b", other), (1, "c", big), (1, "c", big), (2, "d", other)] + [(i, "e", "hot " * 400) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted([(5, "a", 1200, None), (5, "b", 2000, None), (1, "c", 1200, 5), (1, "c", 1200, 5), (2, "d", 2000, 5)] + [(i, "e", 1600, None if i == 159 else 159) for i in range(100, 160)], key=str)
    for limit in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
        got = warc.round_trip(df).collect()
        assert sorted(((r.page_id, r.url, r.payload_bytes, r.refers_to) for r in got), key=str) == want


def test_warc_with_columns_named_as_its_own(spark):
    big = "z" * 3_000_000
    names = ["keeper", "n", "payload_digest", "file", "offset", "length", "record_type", "refers_to"]
    rows = [(1, "u", big, *"abcdefgh"), (2, "u", big, *"abcdefgh"), (3, None, None, *[None] * 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{x} string" for x in names))
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in round_trip(df, min_bytes=1000).collect()}
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert got == {1: (3_000_000, digest, "revisit", 2), 2: (3_000_000, digest, "response", None), 3: (0, hashlib.sha1(b"").hexdigest(), "response", None)}
    assert round_trip(df.limit(0)).count() == 0
