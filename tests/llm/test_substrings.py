"""Repeated windows against a plain pass in order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tendril.llm.substrings import without_repeats

SCHEMA = "doc_id long, text string, spans string, n_words int"


def expected(rows, window):
    seen, out = set(), {}
    docs = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for d in sorted(docs):
        w, gone = docs[d], set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(spark, rows, window, anchor=8, verify=False):
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in without_repeats(df, window, anchor, verify).collect()}
    assert got == expected(rows, window)


def test_like_one_pass(spark):
    r = random.Random(2)
    passages = [[f"p{r.randrange(9)}" for _ in range(40)] for _ in range(4)]
    rows = []
    for d in range(160):
        w = []
        for _ in range(r.randrange(0, 5)):
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randrange(20)
                w += p[a : a + r.randrange(5, 40)]
            else:
                w += [f"w{r.randrange(5)}" for _ in range(r.randrange(1, 30))]
        rows.append((d * 2, r.choice([" ", "\n", " \x0b"]).join(w)))
    check(spark, rows, 20)
    check(spark, rows, 6, 3, True)


def test_odd_rows(spark):
    line = " ".join(f"x{k}" for k in range(25))
    rows = [(1, None), (2, ""), (3, "  "), (4, line), (5, line), (6, line + " " + line), (7, "same " * 30_000), (-1, line + " É"), (8, " ".join(line.split()[:19]))]
    check(spark, rows, 20)


def test_null_id_and_empty_table(spark):
    line = " ".join(f"x{k}" for k in range(25))
    df = spark.createDataFrame([(None, line, "a", 1), (3, line, "a", 1), (9, line, "a", 1)], SCHEMA)
    assert sorted((str(r.doc_id), r.n_removed) for r in without_repeats(df).collect()) == [("3", 0), ("9", 25), ("None", 0)]
    assert without_repeats(df.limit(0)).count() == 0


def test_factors_name_their_place(spark):
    """A factor's words stand at its place, which is earlier; the longest run there is one factor."""
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(40)]
    texts = {1: a, 2: b, 5: ["x", *a[10:50], *b[:30], "y"], 7: a[5:55], 8: a + b}
    df = spark.createDataFrame([(d, " ".join(w), "s", 1) for d, w in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: r.factors for r in without_repeats(df, 20, verify=True).collect()}
    assert [(f.first, f.last, f.ref_doc, f.ref_start) for f in got[5]] == [(1, 41, 1, 10), (41, 71, 2, 0)]
    assert not got[1] and not got[2] and [(f.first, f.last, f.ref_doc) for f in got[7]] == [(0, 50, 1)]
    for d, fs in got.items():
        for f in fs:
            assert (f.ref_doc, f.ref_start) < (d, f.first) and texts[d][f.first : f.last] == texts[f.ref_doc][f.ref_start : f.ref_start + f.last - f.first]


def test_clashes_of_hashes_are_found(spark):
    """Windows meet by 2 or 9 hash bits: their words tell them apart, and the parse is done again with more."""
    from tendril.llm.substrings import _parsed, false_factors

    r = random.Random(5)
    passage = [f"p{k}" for k in range(50)]
    rows = [(d, " ".join([f"w{r.randrange(7)}" for _ in range(r.randrange(40))] + passage[r.randrange(20) :])) for d in range(60)]
    for parts in (1, 5):  # within a batch and across batches
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert false_factors(_parsed(df, 20, 8, 0, 95, True)).count() == 0
        assert false_factors(_parsed(df, 20, 8, 0, 2, True)).count() > 0
        got = {x.doc_id: (x.n_words, x.n_removed, x.text) for x in without_repeats(df, 20, bits=(2, 9, 95)).collect()}
        assert got == expected(rows, 20)
        with pytest.raises(RuntimeError):
            without_repeats(df, 20, bits=(2,))


def test_factors_are_held_against_their_places(spark):
    """A span whose words changed since, and one that nobody read, are false."""
    from tendril.llm.substrings import _parsed, false_factors

    line = " ".join(f"x{k}" for k in range(30))
    df = spark.createDataFrame([(1, line), (2, line), (3, "y " + line)], "doc_id long, text string").repartition(3, "doc_id")
    parsed = _parsed(df, 20, 8, 0, 95, True)
    asked = parsed.selectExpr("sum(size(asked)) AS n").first().n
    assert asked == 1 and false_factors(parsed).count() == 0  # two documents name the same span
    spoilt = parsed.withColumn("asked", F.transform("asked", lambda x: x.withField("digest", F.lit("other").cast("binary"))))
    unread = parsed.withColumn("asked", F.slice("asked", 1, 0))
    assert [(x.doc_id, x.start, x.words) for x in false_factors(spoilt).collect()] == [(1, 0, 30)] == [tuple(x) for x in false_factors(unread).collect()]


def test_repeated_ids(spark):
    line = " ".join(f"x{k}" for k in range(25))
    df = spark.createDataFrame([(3, line, "a", 1), (3, line, "a", 1), (3, "b " + line, "a", 1), (None, line, "a", 1), (2, "short", "a", 1), (2, None, "a", 1)], SCHEMA)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in without_repeats(df).collect())
    assert got == [("2", 0, 0), ("2", 1, 0), ("3", 25, 25), ("3", 25, 25), ("3", 26, 0), ("None", 25, 0)]
