"""Vector links against all pairs; recall of the bands."""

import numpy as np
import pyarrow as pa

import tendril.llm.neardup as N

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def expected(rows):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    ids = sorted(ok)
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = ok[a], ok[b]
            if len(x) == len(y) and (rows_equal(x, y) or x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def rows_equal(x, y):
    return bool((x == y).all())


def vectors(n, seed=1):
    g = np.random.default_rng(seed)
    base = g.standard_normal((n // 6, 16))
    out = []
    for k in range(n):
        v = base[g.integers(len(base))] + g.standard_normal(16) * g.choice([0, 0.05, 0.3])
        out.append((k * 3, [float(np.float32(x)) for x in v]))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}


def test_like_all_pairs(spark):
    odd = [
        (-5, None), (-4, []), (-3, [0.0] * 16), (-2, [float("nan")] + [1.0] * 15), (-1, [None] + [1.0] * 15), (9001, [1.0, 2.0]), (9002, [2.0, 4.0]),
        (9003, [float("inf")] + [1.0] * 15)
    ]
    rows = vectors(240) + odd
    assert got(spark, rows) == expected(rows)


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 7)
    rows = vectors(120, 5)
    assert got(spark, rows) == expected(rows)


def test_doubles(spark):
    rows = vectors(60, 3)
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_duplicates(df).collect()} == expected(rows)


def test_empty(spark):
    assert got(spark, []) == {}


def test_bands_recall():
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (500, 10**6, 10**9):
        bits, bands = N.bands_for(n)
        assert 1 - (1 - agree**bits) ** bands >= 0.999
    assert bands < 200


def test_measured_recall(spark):
    """Searches of every id divisible by 50 against all rows, by brute force."""
    g = np.random.default_rng(8)
    base = g.standard_normal((400, 32))
    x = np.float32(base[g.integers(400, size=6000)] + g.standard_normal((6000, 32)) * g.choice([0.2, 0.3, 0.35], size=(6000, 1)))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = {k: int((unit @ unit[k] >= 0.9).sum()) - 1 for k in range(0, 6000, 50)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in N.near_duplicates(df).where("vec_id % 50 = 0").collect()}
    assert sum(want.values()) > 300 and all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-2.0, 1.0]), (None, [1.0, 2.0]), (4, [2.0, 4.1]), (4, None), (5, [-0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 0, None, True), (4, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)], key=repr)


def test_one_very_common_vector(spark):
    rows = [(k, [1.0, float(k > 2500)]) for k in range(3000)] + [(5000, [1.01, 0.0])]
    got_ = got(spark, rows)
    assert got_[7] == (2501, 0, False) and got_[2600] == (498, 2501, False) and got_[5000] == (2501, 0, False) and got_[0] == (2501, 0, True)


def test_estimate_is_unbiased_and_bounded():
    g = np.random.default_rng(0)
    for width in (8, 64, 300):
        x = g.standard_normal((400, width)) + g.standard_normal(width)
        x /= np.linalg.norm(x, axis=1)[:, None]
        code, factor = N.encode(x)
        group = {"rep": np.arange(400), "code": pa.array([c.tobytes() for c in code]), "factor0": factor[:, 0], "factor1": factor[:, 1]}
        s = N.Side(group, np.arange(400), width, 8, 4)
        cosine = x @ x.T
        said, spread = N.estimates(s, s, slice(0, 400), 0.5)
        off = (cosine >= 0.5) & ~np.eye(400, dtype=bool)
        error = (said - cosine)[off]
        assert abs(error.mean()) < 0.02 and (np.abs(error) <= N.CONFIDENCE * spread[off]).all()
        i, j = N.possible_pairs(s, s, 0, True, 0.9)
        assert set(zip(*np.nonzero(np.triu(cosine >= 0.9, 1)))) <= set(zip(i, j)) and len(i) < 400 * 399 / 2
