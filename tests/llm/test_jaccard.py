"""The Jaccard join against all pairs, on texts with many near copies."""

import random
import re

import pytest

from tendril.llm.jaccard import one_of_each, similar_documents

SCHEMA = "doc_id long, text string, component_id string, n int"


def expected(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(df).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("seed", [1])
def test_like_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(400))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(r.choice([3, 6, 12, 40, 90]))] for _ in range(12)]
    rows = []
    for doc in range(420):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = w + passage
        rows.append((doc * 3, " ".join(w) if r.random() < 0.9 else " ".join(w).upper()))
    check(spark, rows)


def test_odd_rows(spark):
    long_text = " ".join(f"v{k % 5000}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One\x0bTWO"), (6, "one two three four five"), (7, "one two three four five"),
        (8, "É a b c d"), (9, "é a b c d"), (10, long_text), (11, long_text + " end"), (12, "one  two"), (-3, "ONE two")
    ]
    check(spark, rows)


def test_empty_table_and_null_id(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b", "x", 1), (5, "a b", "x", 1), (9, "a b", "x", 2)], SCHEMA)
    assert sorted(map(tuple, similar_documents(df).collect()), key=str) == [(5, 1, 5), (9, 1, 5), (None, 1, None)]
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["5", "None"]


def test_lists_longer_than_a_part(spark, monkeypatch):
    import tendril.llm.jaccard as j

    monkeypatch.setattr(j, "LIST", 8)
    r = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for doc in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((doc, " ".join(w)))
    check(spark, rows)


def test_repeated_ids(spark):
    copy, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(40))
    rows = [(3, copy), (3, copy), (3, other), (8, other + " end"), (2, copy + " x"), (9, None), (9, "")]
    got = similar_documents(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(2, 57, 2), (3, 36, 3), (3, 56, 2), (3, 56, 2), (8, 37, 3), (9, 0, 9), (9, 0, 9)]


def test_members_are_not_lost(spark, monkeypatch):
    """Chains of texts near the threshold: members link where their leaders do not."""
    import tendril.llm.jaccard as j

    monkeypatch.setattr(j, "MEMBERS", 3)
    r = random.Random(3)
    rows, doc = [], 0
    for chain in range(40):
        base = [f"c{chain}w{k}" for k in range(r.choice([20, 45, 80]))]
        for step in range(r.randrange(2, 14)):
            cut = r.randrange(0, max(1, len(base) // 9))
            base = base[cut:] + [f"c{chain}s{step}n{k}" for k in range(r.randrange(0, max(1, len(base) // 9)))]
            for _ in range(r.randrange(1, 4)):
                rows.append((doc * 7919 % 10007, " ".join(base[: len(base) - r.randrange(0, 3)])))
                doc += 1
    check(spark, rows)


def test_one_of_each_row(spark):
    copy, near, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59)), " ".join(f"v{k}" for k in range(60))
    rows = [(None, copy), (None, copy), (None, near), (4, other), (4, other), (4, copy), (3, near), (None, "alone in this"), (9, None), (9, None)]
    kept = one_of_each(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), keep_nulls=False).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(4, other), (3, near), (None, "alone in this"), (9, None), (9, None)], key=repr)
    nulls = one_of_each(spark.createDataFrame([(None, t, "x", 1) for t in (copy, near, copy)], SCHEMA), keep_nulls=False)
    assert nulls.count() == 1
