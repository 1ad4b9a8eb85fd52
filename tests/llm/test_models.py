"""Held-out accuracy of the classifiers, and their odd rows."""

import os

import zlib

import numpy as np
import pytest

import tendril.llm.language as L
from tendril.llm.language import languages
from tendril.llm.quality import accepted, judged

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
DOCS, LABELS = "doc_id long, text string, lang string, score string", "doc_id long, quality int, text string"


@needs_data
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = judged(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and got.score.between(0, 1).all()
    assert (got[got.quality == 1].predicted == 1).mean() >= 0.97


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97 and got.score.between(0, 1).all()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", ""), (2, "", "a", ""), (None, "x", "a", ""), (3, "word " * 50_000, "a", ""), (3, "b", "a", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert judged(docs, none).count() == 5 and {r.predicted for r in judged(docs, none).collect()} == {1}
    assert accepted(docs, none).count() == 5 and accepted(docs, none).columns == docs.columns
    odd = spark.createDataFrame([(3, 1, ""), (3, 0, ""), (3, 1, ""), (None, 1, ""), (77, 0, ""), (1, None, ""), (2, 5, "")], LABELS)
    assert judged(docs, odd).count() == 5
    assert judged(docs.limit(0), odd).count() == 0


def test_language_odd_rows(spark):
    rows = [(k, "the house and the garden", "en", "") for k in range(30)] + [(100 + k, "la maison et le jardin été", "fr", "") for k in range(30)] + [
        (200, None, "en", ""), (201, "", "en", ""), (202, "123 !!", "fr", ""), (203, "été et jardin", None, ""), (204, "日本語", None, ""),
        (205, "the " * 30_000, None, ""), (None, "the garden", None, "")
    ]
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k] == ("und", 0.0) for k in (200, 201, 202))
    assert got[203][0] == "fr" and got[205][0] == "en" and got[204][0] in ("en", "fr") and got[None][0] == "en"
    assert languages(spark.createDataFrame([], DOCS)).count() == 0
    alone = languages(spark.createDataFrame([(1, "abc", None, "")], DOCS)).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)


def test_phrases_like_a_plain_parse():
    g = np.random.default_rng(4)
    for size in (1, 40, 700):
        model = g.integers(0, 5, size).astype(np.uint8)
        texts = [g.integers(0, 6, n).astype(np.uint8) for n in (0, 1, 17, 256, 257, 900)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = L.phrases([L.automaton(model)], np.concatenate(texts), at)[:, 0]
        known = model.tobytes()
        for t, n in zip(texts, got):
            want = 0
            for begin in range(0, len(t), L.STRETCH):
                rest = t[begin : begin + L.STRETCH].tobytes()
                while rest:
                    k = 1
                    while k < len(rest) and rest[: k + 1] in known:
                        k += 1
                    rest, want = rest[k:], want + 1
            assert n == want


def test_language_of_signs_and_repeated_rows(spark):
    rows = [(k, "the house and the garden", "en", "") for k in range(9)] * 2 + [
        (300 + k, t, "en", "") for k, t in enumerate(["²", "½ ①", "Ⅷ", "٣", "_"])
    ] + [(400, "ª", None, ""), (400, "the", None, "")]
    got = [(r.doc_id, r.lang_pred) for r in languages(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == len(rows) and sorted(got)[-7:] == [*((300 + k, "und") for k in range(5)), (400, "en"), (400, "en")]


def test_language_bounds(spark):
    """Equal shares of the documents; every label value is learnt, of smaller shares where they are many."""
    rows = [(k, "abcdefgh " * 9000 if k == 1 else "zyxw", "a", "") for k in range(40)] + [(100 + k, "word", f"junk{k}", "") for k in range(30)]
    model = L.learn(spark.createDataFrame(rows, DOCS), symbols_each=600)
    assert list(model)[0] == "a" and len(model) == 1 + sum(zlib.crc32(str(100 + k).encode()) % 3 != 1 for k in range(30))
    share = 600 // model["a"].count(b"\0") - 1
    assert max(map(len, model["a"].split(b"\0"))) <= share and len(model["a"]) <= 600
    few = L.learn(spark.createDataFrame(rows, DOCS), symbols_each=600, all_symbols=1000)
    assert set(few) == set(model) and sum(map(len, few.values())) <= 1000


def plain_phrases(text, model):
    """A greedy parse by searching: the longest piece of a stretch that the model's text has, from each place on."""
    total = 0
    for k in range(0, len(text), L.STRETCH):
        s, i = text[k : k + L.STRETCH], 0
        while i < len(s):
            j = i + 1
            while j < len(s) and s[i : j + 1] in model:
                j += 1
            i, total = j, total + 1
    return total


def test_choice_of_language_in_passes(spark):
    """Language and score as a plain parse has them, whatever the number of languages that are held at once."""
    rng = np.random.default_rng(8)
    texts = {
        n: " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(60)) for n,
        alphabet in (("b", "abcde"), ("a", "abcdx"), ("d", "xyzv"), ("c", "abcde"), ("e", "éàüo"))
    }
    sym = lambda t: L.symbols(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0].tobytes()
    model = {n: sym(t) for n, t in texts.items()}
    docs = [
        (k, " ".join("".join(rng.choice(list("abcdexyzvéàüo"), rng.integers(1, 9))) for _ in range(rng.integers(1, 90))), "", "") for k in range(60)
    ] + [(99, None, "", ""), (98, "12 - 3", "", "")]
    want = {}
    for k, t, *_ in docs:
        if not t or not any(c.isalpha() for c in t):
            want[k] = ("und", 0.0)
            continue
        ranked = sorted((plain_phrases(sym(t), model[n]), n) for n in model)
        want[k] = (ranked[0][1], 1 - ranked[0][0] / max(1, ranked[1][0]))
    for at_once in (128, 2, 1):
        got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(docs, DOCS), model, at_once).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_wide_automata():
    """More states than 16 bits hold."""
    text = np.random.default_rng(3).integers(1, 20, 40_000).astype(np.uint8)
    table = L.automaton(text)
    assert table.dtype == np.uint32
    s = np.concatenate([text[7000:7200], text[30_000:30_056]])
    assert L.phrases([table], s, np.array([0, len(s)]))[0, 0] == plain_phrases(s.tobytes(), text.tobytes()) <= 4


def test_preferences_like_a_plain_fit():
    """The weights of pairs that are never laid out, against Newton steps on the laid out differences."""
    from tendril.llm.quality import preferences

    g = np.random.default_rng(2)
    x, ridge = g.standard_normal((60, 5)), np.array([0.01, 0.01, 0.1, 0.1, 1.0])
    wins, loses = g.integers(0, 30, 400), g.integers(30, 60, 400)
    x[:30] += 0.4
    d, w = x[wins] - x[loses], np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / 400 + np.diag(ridge), d.T @ (1 - p) / 400 - ridge * w)
    assert np.allclose(preferences(x, wins, loses, ridge), w, atol=1e-5)


def test_quality_ties_at_the_cut():
    """Equal strengths stand on one side of the cut."""
    from tendril.llm.quality import THRESHOLD, BradleyTerry

    good, bad = np.ones((6, 4), dtype=np.float32), np.zeros((6, 4), dtype=np.float32)
    model = BradleyTerry.fit(np.concatenate([good, bad[:1]]), np.concatenate([bad, good[:1]]), 0.5)
    scores = model.score(np.concatenate([good, bad]))
    assert len(set(scores[:6])) == len(set(scores[6:])) == 1 and scores[0] >= THRESHOLD > scores[6]
