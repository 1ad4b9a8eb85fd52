"""Benchmark windows against a plain search of every place."""

import hashlib
import random
import re

import tendril.llm.decontaminate as D

DOCS, BENCH = "doc_id long, text string, item_id string, window int", "item_id long, text string, doc_id string"


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def expected(docs, bench, window=10):
    patterns = {}
    for item, text in bench:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else ():
            patterns.setdefault(tuple(w[k : k + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for p, owners in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    items |= owners
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, bench):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in bench], BENCH)
    got = D.contaminated(d, b)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, bench)
    return d, b


def cases():
    r = random.Random(3)
    vocab = ["a", "bb", "c9", "é", "ß", "dd", "e", "f"]
    bench = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 10, 14])))) for k in range(12)] + [(None, "only null"), (99, None), (5, "!!")]
    docs = []
    for k in range(150):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.5:
            w[3:3] = words(bench[r.randrange(12)][1])
        docs.append((k, r.choice([" ", "-", "\n"]).join(w).upper()))
    return [*docs, (200, None), (201, ""), (202, "..."), (203, "a " * 20_000)], bench


def test_like_plain_search(spark):
    docs, bench = cases()
    check(spark, docs, [b for b in bench if len(words(b[1])) != 1])
    check(spark, docs[:40], bench)


def test_in_parts(spark):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in bench], BENCH)
    got = D.find_benchmark(d, b, most_bytes=900)
    n = {r.doc_id: (sum(h["last"] - h["first"] for h in r.hits), len(r.items)) for r in got.collect()}
    assert n == {e[0]: (e[2], e[3]) for e in expected(docs, bench)}


def test_empty_and_filter(spark):
    docs, bench = [(1, "x y"), (2, None)], []
    d, b = check(spark, docs, bench)
    assert D.without_benchmark(d, b).count() == 2
    assert D.contaminated(d.limit(0), b).count() == 0
    b = spark.createDataFrame([(1, "x y", "z")], BENCH)
    kept = D.without_benchmark(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_null_and_repeated_ids(spark):
    docs = [(None, "x y"), (None, "a b"), (None, "a b"), (None, "q r"), (7, "x y"), (7, "c d"), (7, "u v"), (8, None)]
    d, b = check(spark, docs, [(1, "x y"), (2, "u v")])
    clean = sorted([(None, "a b"), (None, "a b"), (None, "q r"), (7, "c d"), (8, None)], key=repr)
    for most in (D.MOST_TABLE_BYTES, 1):  # in one part and in two
        kept = D.without_benchmark(d, b, most_bytes=most)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == clean
        hits = D.find_benchmark(d, b, most_bytes=most).collect()
        assert sorted(((r.doc_id, r.n_words, len(r.hits), r["items"]) for r in hits), key=repr) == sorted(
            ((i, len(words(t)), int(t in ("x y", "u v")), [k for k, x in (("1", "x y"), ("2", "u v")) if x == t]) for i, t in docs), key=repr
        )


def test_tables_are_bounded(tmp_path):
    """The bytes of a part's tables are no more than was counted, but for the least shift tables."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5))) for _ in range(400)) for _ in range(2000)]
    texts += ["same " * 30_000, "same " * 30_000]
    part = D.Part.build([f"{k:04d}" for k in range(len(texts))], pa.array(texts), 10)
    packed = part.packed()
    counted = sum(len(t) + D._WORD_BYTES * len(t.split()) for t in texts)
    assert len(packed) <= counted
    again = D.Part.unpacked(packed)
    assert again.names == part.names and all((x == y).all() for a, b in zip(part.matchers, again.matchers) for x, y in zip(a.arrays().values(), b.arrays().values()))
    found = list(D._found(pa.array([texts[5] + " x", "same " * 12]), again))
    assert found[0][4][0] == {5} and found[0][4][1] == {2000, 2001} and len(np.unique(part.matchers[0].bucket)) <= len(part.matchers[0].bucket)
