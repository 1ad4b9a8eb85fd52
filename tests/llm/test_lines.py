"""Line dedup against a plain version."""

import hashlib
import random
from collections import defaultdict

import pytest

from tendril.llm.lines import BLANKS, Runs, hashed_lines, without_repeated_lines

SCHEMA = "doc_id long, text string, gone string, row string, n_lines string"


def key(line):
    return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})


def plain(rows, chars, docs):
    held = defaultdict(list)
    for k, (doc, text, *_) in enumerate(rows):
        for line in {key(x) for x in (text or "").split("\n")}:
            if len(line) >= chars:
                held[line].append((doc is not None, doc or 0, k))
    keeper = {line: max(x[:2] for x in who) for line, who in held.items() if len(who) >= docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] in ((doc is not None, doc or 0), (False, 0))]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def show(rows):
    return sorted((repr(r) for r in rows))


@pytest.mark.parametrize("seed,batches,fan", [(1, 1, 2), (2, 4, 2), (3, 7, 3)])
def test_against_plain(spark, seed, batches, fan):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("aAbB é") for _ in range(rng.choice([0, 3, 9, 10, 12]))) for _ in range(60)]
    rows = [(k * 3 % 211, "\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 4, 30]))), "x", "y", "z") for k in range(160)]
    rows += [
        (None, None, "x", "y", "z"), (7, "", "x", "y", "z"), (None, "\n".join(lines), "x", "y", "z"), rows[3], rows[3],
        (900, " \t" + lines[5].swapcase() + "\r\n\n" + "é" * 40, None, None, None)
    ]
    got = without_repeated_lines(spark.createDataFrame(rows, SCHEMA), 9, 3, batches, fan).collect()
    assert show(tuple(r) for r in got) == show(plain(rows, 9, 3))
    assert sum(r.n_dropped for r in got) > 50


def test_hot_line_and_very_long_document(spark):
    hot = "Accept all cookies to go on reading this page"
    rows = [(k, f"{hot}\nown words of document {k:07d} that are nowhere else", "x", "y", "z") for k in range(3000)]
    rows.append((5000, "\n".join(f"line {k} of the very long document, number {k}" for k in range(30_000)) + "\n" + hot.upper(), "x", "y", "z"))
    got = {r.doc_id: r for r in without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5000].n_lines == 30_001 and got[5000].n_dropped == 0
    assert all(got[k].n_dropped == 1 and hot not in got[k].text for k in range(3000))
    assert without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_levelled_and_sorted(spark):
    runs = Runs(spark, least_docs=2, fan=2)
    for low in (30, 20, 10):
        docs = spark.createDataFrame(
            [(low + k, "a line that many documents hold here\n" + hashlib.md5(str(low + k).encode()).hexdigest()) for k in range(5)],
            "doc_id long, text string"
        )
        runs.add(hashed_lines(docs, 30))
    assert [len(x) for x in runs.levels] == [1, 1]
    found = runs.settled()
    plan = found[0].select("h", "g").join(found[1].select("h", "g").hint("merge"), ["h", "g"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert [r.keeper for r in runs.close().collect()] == [34]
    runs.drop()


def test_native(spark):
    plan = without_repeated_lines(spark.createDataFrame([(1, "a", "", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
