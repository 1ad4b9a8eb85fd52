"""Token files and WARC files: round trips, random access, damage."""

import gzip
import hashlib
import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import pyarrow as pa
from tendril.llm import tokens as T
from tendril.llm import warc as W
from tendril.llm.queries import tokenizer_path

DOCS, PAGES = "doc_id long, text string, path string, part string", "page_id long, url string, html string, shard string"


def texts():
    r = random.Random(9)
    pieces = ["a", "Word", "é", " ", "  ", "\n", "\n\n", "'s", "1", "&&", " ", "\r\n", "<|endoftext|>", " <|endoftext|>", "日本", "😀", "."]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(0, 15))) for _ in range(300)] + [None, "", "long " * 40_000]


@pytest.mark.parametrize("split", [True, False, None])
def test_ids_round_trip(spark, tmp_path, split):
    from tokenizers import Tokenizer

    rows = [(k * 7 % 1009, t, "p", "q") for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    files = T.write_sequences(df, tokenizer_path(), str(tmp_path / "out"), length=64, split=split)
    got = sorted(map(tuple, T.read_documents(files).collect()))
    tok, at, want, every = Tokenizer.from_file(tokenizer_path()), 0, [], []
    for doc, text, _, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
        every += ids
    assert got == want
    first = min(files.collect(), key=lambda r: r.part)
    ids, mask = T.read_sequence(first.path, first.part, 1)
    assert ids.tolist() == every[64:128] and mask.all()
    last = (first.n_tokens - 1) // 64
    _, mask = T.read_sequence(first.path, first.part, last)
    assert mask.sum() == first.n_tokens - last * 64


def test_kind_of_tokenizer_and_files_by_bytes(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    words = public_tokenizers.path("word_bpe_49k.json")
    assert T.splits(tokenizer_path()) and not T.splits(words)
    rows = [(k, "Some words of a text, é", "p", "q") for k in range(40)]
    monkeypatch.setattr(T, "FILE_BYTES", 100)
    files = T.write_sequences(spark.createDataFrame(rows, DOCS), words, str(tmp_path / "out"))
    assert files.count() == 10
    n = len(Tokenizer.from_file(words).encode(rows[0][1], add_special_tokens=False).ids) + 1
    assert {r.n_tokens for r in T.read_documents(files).collect()} == {n}


def test_no_documents_and_null_id(spark):
    df = spark.createDataFrame([], DOCS)
    assert T.tokens_written(df, tokenizer_path()).count() == 0
    df = spark.createDataFrame([(None, "x", "", ""), (1, "x", "", ""), (1, "x", "", "")], DOCS)
    assert sorted((str(r.doc_id), r.start) for r in T.tokens_written(df, tokenizer_path()).collect()) == [("1", 2), ("1", 4), ("None", 0)]


def pages():
    r = random.Random(1)
    return [
        (k * 3, f"http://x/{k}\r\n", None if k % 50 == 3 else "é\r\n\r\n" * r.randrange(0, 40), "s") for k in range(400)
    ] + [(None, None, None, "s"), (6, "http://twice", "x" * 300_000, "s")]


def test_audit_finds_the_damage(spark):
    df = spark.createDataFrame(pages(), PAGES)
    got = W.drill(df, F.col("ordinal") % 37 == 5, per_shard=256).collect()
    assert len(got) == 402
    for r in got:
        assert r.damaged == (r.ordinal % 37 == 5)
    one = next(r for r in got if r.page_id == 9)
    plain = W.record(one.shard, one.ordinal, "http://x/3\r\n", None)
    assert one.sha256 == hashlib.sha256(plain).hexdigest() and one.length == len(plain)
    assert not any(r.damaged for r in W.drill(df, F.lit(False), per_shard=256).collect())


def test_shards_are_cut_by_bytes(spark, tmp_path):
    """However small the files, records have the same places in their shard's stream; one shard may hold nearly all bytes."""
    df = spark.createDataFrame(pages(), PAGES)
    places = lambda m: sorted((str(r.page_id), r.shard, r.ordinal, r.offset, r.length, r.sha256) for r in m.collect())
    whole = W.write_warc(df, str(tmp_path / "whole"), 256)
    assert {r.part for r in whole.collect()} == {0}
    cut = W.write_warc(df, str(tmp_path / "cut"), 256, file_bytes=5000)
    assert places(cut) == places(whole) and len(list((tmp_path / "cut").iterdir())) == cut.select("shard", "part").distinct().count() > 20
    got = {(r.shard, r.ordinal): r for r in cut.collect()}
    for r in got.values():
        before = got.get((r.shard, r.ordinal - 1))
        assert r.offset == (before.offset + before.length if before else 0)
    for name in (tmp_path / "cut").iterdir():
        plain = gzip.decompress(name.read_bytes())  # the file is one gzip stream of its own record and pages
        fields, body = W.parse_record(plain)
        assert fields["WARC-Type"] == "warcinfo" and fields["WARC-Filename"] == name.name and body.startswith(b"software")
        stay = [r for r in got.values() if W.file_name(r.shard, r.part) == name.name]
        assert len(plain) - len(W.info_record(name.name)) == sum(r.length for r in stay)
        if stay[0].page_id is not None:  # a file's last id begins where the file is not full; rows of one id stay together
            begins = {}
            for r in stay:
                begins[r.page_id] = min(r.offset, begins.get(r.page_id, r.offset))
            assert max(begins.values()) - min(begins.values()) < 5000
    found = W.drill(df, F.col("ordinal") % 37 == 5, per_shard=256, file_bytes=5000).collect()
    assert len(found) == 402 and all(r.damaged == (r.ordinal % 37 == 5) for r in found)


def test_missing_file_and_records(spark, tmp_path):
    import os

    df = spark.createDataFrame(pages(), PAGES)
    m = W.write_warc(df, str(tmp_path / "w"), 256)
    os.remove(tmp_path / "w" / "shard-1.warc.gz")
    theirs = W.merkle(W.read_warc(m, str(tmp_path / "w")), 256, 4)
    bad = W.audit(W.merkle(m, 256, 4), theirs, 256).collect()
    assert {r.shard for r in bad} == {1} and len(bad) == m.where("shard = 1").count()
    fields, body = W.parse_record(W.record(1, 2, "u\n", "é"))
    assert fields["WARC-Target-URI"] == "u%0A" and body.decode() == "é"
    assert uuid.UUID(fields["WARC-Record-ID"][10:-1]) != uuid.UUID(W.record_id(1, 3)[9:]) and fields["WARC-Date"].endswith("Z")
    assert W.drill(df.limit(0), F.lit(True)).count() == 0


def test_damage_that_unpacks(spark, tmp_path):
    """A record that another one replaces, records that are swapped, and a file that is cut short."""
    df = spark.createDataFrame([(k, "u", f"page {k % 10}", "s") for k in range(500)], PAGES)
    m = W.write_warc(df, str(tmp_path / "w"), 128)
    at = {(r.shard, r.ordinal): r for r in m.collect()}
    raw = {s: bytearray((tmp_path / "w" / f"shard-{s}.warc.gz").read_bytes()) for s in range(4)}
    member = lambda r: bytes(raw[r.shard][r.file_offset : r.file_offset + r.file_length])
    put = lambda r, b: raw[r.shard].__setitem__(slice(r.file_offset, r.file_offset + r.file_length), b)
    one, two = at[0, 5], next(r for r in at.values() if r.shard == 0 and r.ordinal > 5 and r.file_length == at[0, 5].file_length)
    a, b = member(one), member(two)
    put(one, b), put(two, a)
    other = at[2, 7]
    for k in range(1 << 16):
        plain = gzip.decompress(member(other)).replace(b"page 3", b"pa%04x" % k)
        if len(packed := gzip.compress(plain, mtime=0)) == other.file_length and b"page" not in plain:
            break
    put(other, packed)
    for s, data in raw.items():
        cut = at[3, 90].file_offset + 3 if s == 3 else None
        (tmp_path / "w" / f"shard-{s}.warc.gz").write_bytes(data[:cut])
    bad = W.audit(W.merkle(m, 128, 3), W.merkle(W.read_warc(m, str(tmp_path / "w")), 128, 3), 128).collect()
    assert {(r.shard, r.ordinal) for r in bad} == {(0, 5), (0, two.ordinal), (2, 7)} | {k for k in at if k[0] == 3 and k[1] >= 90}


def test_null_and_equal_pages(spark):
    """Null ids in as many shards as they need; equal rows are records of their own."""
    rows = [(None, f"u{k}", "x", "s") for k in range(300)] + [(7, "u", "x", "s")] * 40
    got = W.drill(spark.createDataFrame(rows, PAGES), F.col("shard") == -1, per_shard=64).collect()
    assert len(got) == 340 and len({(r.shard, r.ordinal) for r in got}) == 340
    assert len({r.shard for r in got if r.shard < 0}) == 5 and all(r.damaged == (r.shard == -1) for r in got)


def test_pieces_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """Every hash clashes: texts are then encoded whole, and the ids are right."""
    import public_tokenizers
    from tendril.llm import kernels, tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two three two one", "a bb ccc\n dddd", "", "two"]
    column = pa.array(texts)
    want = [(ids.tolist(), n.tolist()) for _, _, ids, n in tokens.Encoder(path, 2, False).slices(column)]
    assert [(ids.tolist(), n.tolist()) for _, _, ids, n in tokens.Encoder(path, 2, None).slices(column)] == want
    monkeypatch.setattr(kernels, "mix", lambda h: h & np.uint64(1))
    assert [(ids.tolist(), n.tolist()) for _, _, ids, n in tokens.Encoder(path, 2, None).slices(column)] == want
