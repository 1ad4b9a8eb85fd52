"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendril.llm.align import Counts, Perfect, aligned, aligned_digests, hashed

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, groups string"


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {}
    for n in range(256):
        plain_one = 0x21 <= n <= 0x7E or 0xA1 <= n <= 0xAC or n >= 0xAE
        byte[chr(n) if plain_one else chr(256 + sum(1 for m in range(n) if not (0x21 <= m <= 0x7E or 0xA1 <= m <= 0xAC or m >= 0xAE)))] = bytes([n])
    out, docs = [], Counter()
    for _, text, *_ in rows:
        text = text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [b"".join(byte[c] for c in a.id_to_token(k)) for k in ids_a]
        raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, links = [], []
        low = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(k) for k, e in zip(ids_a, ends_a) if low < e <= end) + "|" + ",".join(str(k) for k, e in zip(ids_b, ends_b) if low < e <= end))
            low = end
        spans = [0, *ends_b]
        j = 0
        for k, (start, end) in zip(ids_a, zip([0, *ends_a], ends_a)):
            while spans[j + 1] <= start:
                j += 1
            m = j
            while m < len(ids_b) and spans[m] < end:
                links.append((k, ids_b[m]))
                m += 1
        docs.update(set(links))
        out.append((len(ids_a), len(ids_b), groups, links))
    best = {}
    for (k, _), n in docs.items():
        best[k] = max(best.get(k, 0), n)
    return [(row[0], na, nb, len(g), len(ls), sum(docs[x] == best[x[0]] for x in ls), sum(docs[x] for x in ls), ";".join(g)) for row, (na, nb, g, ls) in zip(rows, out)]


def texts(seed):
    rng = random.Random(seed)
    words = [
        "the", "Straße", "élève", "don't", "naïve", "日本語", "x" * 70, "3.1415", "<|endoftext|>", "</s>", "<0x41>", "a\nb", " ", "　", "🙂", "\tcode",
        "né", "ing", "anti", "", "", "\r\n", "…", " q"
    ]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts(seed))]
    rows += [
        (None, None, "x", "y"), (3, "", "x", "y"), (3, " ", "x", "y"), (3, "  two", "x", "y"), (4, "a▁b and more", "x", "y"),
        (5, "nul\x00 byte", "x", "y"), (6, "ends in space ", None, None), rows[4], rows[4]
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(repr(tuple(r)) for r in aligned(df, A, B, bucket_pairs=100).collect())
    assert got == sorted(map(repr, plain(rows)))


def test_digests_and_empty(spark):
    rows = [(1, "one two", "", ""), (2, None, "", "")]
    got = {r.doc_id: r for r in aligned_digests(spark.createDataFrame(rows, SCHEMA), A, B).collect()}
    assert got[1].groups_sha256 == hashlib.sha256(plain(rows)[0][-1].encode()).hexdigest() and got[2].groups_sha256 == ""
    assert aligned(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert aligned(spark.createDataFrame([(1, None, "", "")], SCHEMA), A, B).first().n_a == 0


def test_very_long_text(spark):
    rows = [(1, "word " * 150_000 + "y" * 50_000, "", ""), (2, "word", "", "")]
    got = {r.doc_id: r for r in aligned(spark.createDataFrame(rows, SCHEMA), A, B).collect()}
    assert got[1].n_a > 150_000 and got[1].n_best <= got[1].n_links


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 20_000))
    found = Perfect(*Perfect.of(keys))
    assert sorted(found.number(keys).tolist()) == list(range(len(keys)))
    assert len(found.bits) < 8 * len(keys)
    assert Perfect(*Perfect.of(keys[:0])).number(keys[:3]).tolist() == [-1] * 3


def test_hash_is_that_of_sql(spark):
    values = [0, 1, -1, 1 << 40, 12345678901]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert hashed(np.array(values)).view(np.int64).tolist() == want
    assert Counts("x", 7).bucket_of(np.array(values)).tolist() == [w % 7 for w in want]


def test_lookup_compares_pairs(monkeypatch):
    pairs = np.arange(50, dtype=np.int64)
    sizes, bits = Perfect.of(pairs)
    placed = np.empty_like(pairs)
    placed[Perfect(sizes, bits).number(pairs)] = pairs
    counts = Counts("nowhere", 1)
    counts.held[0] = (Perfect(sizes, bits), placed, placed * 3)
    assert counts.look_up(np.array([4, 4, 49])).tolist() == [12, 12, 147]
    with pytest.raises(ValueError):
        counts.look_up(np.array([51]))
