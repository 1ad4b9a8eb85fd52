"""The pipeline's stages against their operators and brute force."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark):
    import corpus_pipeline as P
    from test_decontaminate import expected as hits
    from test_jaccard import expected as groups

    from tendril.llm.queries import QUERIES
    from tendril.llm.shared import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = dict(P.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    good = {r.doc_id for r in QUERIES["op7_quality"](spark, SF).collect() if r.predicted}
    one = stored(steps["quality"](spark, docs, SF), "t")
    assert one.columns == names and {r.doc_id for r in one.collect()} == good
    two = stored(steps["near_duplicates"](spark, one, SF), "t")
    want = groups([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == names and {r.doc_id for r in two.collect()} == {d for d, (_, c) in want.items() if d == c}
    three = stored(steps["decontamination"](spark, two, SF), "t")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x[0] for x in hits([(r.doc_id, r.text) for r in two.collect()], bench) if not x[5]}
    assert three.columns == names and {r.doc_id for r in three.collect()} == clean
    four = stored(steps["mixing"](spark, three, SF), "t")
    assert four.columns == names and {r.doc_id for r in four.collect()} == clean
    five = steps["token_files"](spark, four, SF)
    assert sorted(r.doc_id for r in five.collect()) == sorted(r.doc_id for r in four.collect())


def test_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0


def test_token_files_in_the_order_of_the_mixture(spark):
    import corpus_pipeline as P

    from tendril.llm.mixing import mixed
    from tendril.llm.shared import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r.doc_id for r in mixed(docs).select("doc_id", "_slot", "_place").orderBy("_slot", "_place").collect()]
    steps = dict(P.STAGES)
    written = stored(steps["mixing"](spark, docs, SF), "t")
    got = [r.doc_id for r in steps["token_files"](spark, written, SF).orderBy("start").collect()]
    assert got == want and got != sorted(got)


def test_odd_tables(spark, monkeypatch):
    """Null and repeated ids, repeated rows, null and empty texts, clashing columns, a benchmark of several parts, an empty table."""
    import corpus_pipeline as P

    import tendril.llm.decontaminate as D
    from tendril.llm.shared import stored

    monkeypatch.setattr(D.without_benchmark, "__defaults__", (D.WINDOW, 3000))
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    said = [r.text for r in base.where("n_chars between 300 and 2000 and lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [
        (None, said[0], "s"), (None, said[1], "s"), (7, said[0], None), (7, said[0], None), (7, said[2], "t"), (8, None, "t"), (9, "", "t"),
        (10, f"{said[3]} {item} {said[4]}", "t"), (None, f"{said[5]} {item}", "t")
    ]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "own", i) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _slot string, _row long")
    steps = dict(P.STAGES)
    kept = {}
    for name in ("quality", "near_duplicates", "decontamination", "mixing"):
        docs = stored(steps[name](spark, docs, SF), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_slot", "_row"] and {r._slot for r in docs.collect()} <= {"own"}
        kept[name] = sorted({(str(r.doc_id), r.text) for r in docs.collect()}, key=repr)
    texts = [t for _, t in kept["near_duplicates"] if t]
    assert len(texts) == len(set(texts)) and ("7", said[0]) in kept["near_duplicates"] and ("None", said[1]) in kept["near_duplicates"]
    assert kept["decontamination"] == [x for x in kept["near_duplicates"] if not (x[1] and item in x[1])] == kept["mixing"]
    assert steps["token_files"](spark, docs, SF).count() == docs.count()
    for name, step in P.STAGES:
        assert step(spark, base.limit(0), SF).count() == 0, name
