"""Less than one block of deviation, nothing lost."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tendril.llm.mixing import STRETCH, Schedule, block_size, laid_out, mixed, natural_weights, planned

SCHEMA = "doc_id long, text string, source string, _slot string"
RNG = random.Random(5)
WEIGHTS = [
    {"a": Fraction(1)},
    {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)},
    natural_weights({"a": 900, "b": 30, "c": 70}),
    {"a": Fraction(999_999, 10**6), "b": Fraction(1, 10**6)},
    {"big": Fraction(1), **{f"s{k}": Fraction(1, 3000 + 701 * k) for k in range(12)}},
    {f"s{k}": Fraction(1 + k * k) for k in range(60)},
    *[{f"s{k}": Fraction(RNG.randint(1, 10**RNG.randint(1, 6))) for k in range(n)} for n in (3, 5, 10, 20, 20)],
]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_less_than_one_block_at_every_slot(weights):
    """Of the exact weight, in integers: |placed * whole - share * slot| < whole."""
    run = Schedule(weights)
    for slot in range(1, 15_001):
        run.next()
        assert max(abs(p * run.whole - x * slot) for p, x in zip(run.placed, run.share)) < run.whole


@pytest.mark.parametrize("states", [10**6, 1])
@pytest.mark.parametrize("weights", WEIGHTS[1:8])
def test_stretches_are_the_schedule(weights, states):
    total = sum(weights.values())
    blocks = {s: max(1, int(20_000 * w / total)) for s, w in weights.items()}
    if min(w / total for w in weights.values()) < Fraction(1, 10**5):
        blocks = {s: 0 if w / total < Fraction(1, 10**5) else n for (s, w), n in zip(weights.items(), blocks.values())}
    starts, placed, slots = planned(weights, blocks, states)
    run, whole = Schedule(weights), []
    for slot in range(slots):
        k = run.next()
        whole.append((run.names[k], run.placed[k] - 1, slot))
    assert [x for start in starts for x in laid_out(weights, start)] == whole
    assert placed == dict(zip(run.names, run.placed)) and all(placed[s] >= n for s, n in blocks.items())
    name, i, _ = whole[-1]
    assert i == blocks[name] - 1 and (len(starts) == 1 if states == 1 else len(starts) == -(-slots // STRETCH))


def test_larger_blocks_where_slots_are_many():
    weights = {"a": Fraction(1), "b": Fraction(1, 999)}
    assert block_size(weights, {"a": 1000, "b": 10}, 16) == 16
    assert block_size(weights, {"a": 10**6, "b": 10}, 16, 10_000) == 128
    with pytest.raises(ValueError):
        Schedule({"a": Fraction(0)})


def test_every_document_is_there(spark):
    rows = [(k, "t", "hot" if k % 3 else None, "z") for k in range(700)] + [(1000 + k, None, f"s{k % 4}", "z") for k in range(40)] + [(5, "t", "hot", "z"), (None, "n", "hot", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_at": F.lit(1), "_before": F.lit(2)})
    out = mixed(df, block=4)
    got = out.collect()
    n = Counter((r.doc_id, r.source) for r in got)
    assert set(n) == {(r[0], r[2]) for r in rows} and n[(5, "hot")] >= 2
    places = [(r._slot, r._place) for r in got]
    assert len(set(places)) == len(places) and len({r._slot for r in got}) == max(r._slot for r in got) + 1
    assert out.columns == ["doc_id", "text", "source", "_at", "_before", "_source", "_slot", "_place"] and {(r._at, r._before) for r in got} == {(1, 2)}
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r._slot, r._source) == r._source
    assert mixed(df.limit(0)).count() == 0


def test_repeated_rows_over_several_passes(spark):
    """A small source of equal rows comes round many times, in blocks that its end falls into."""
    rows = [(1, "same", "small", "z")] * 3 + [(k, "t", "large", "z") for k in range(10, 200)]
    got = mixed(
        spark.createDataFrame(rows, SCHEMA).withColumnRenamed("_slot", "_ownX").withColumn("_ownX_", F.lit(7)),
        weights={"small": Fraction(1), "large": Fraction(1)}, block=4
    ).collect()
    n = Counter(r.doc_id for r in got)
    assert n[1] in range(188, 193) and all(n[k] >= 1 for k in range(10, 200)) and {r._ownX_ for r in got} == {7}
    assert len({(r._slot, r._place) for r in got}) == len(got)


def test_given_weights(spark):
    df = spark.createDataFrame([(k, "t", "ab"[k % 2], "z") for k in range(400)], SCHEMA)
    got = Counter(r._source for r in mixed(df, weights={"a": Fraction(3), "b": Fraction(1)}, block=2).collect())
    assert got["b"] == 200 and 590 <= got["a"] <= 610
    with pytest.raises(ValueError):
        mixed(df, weights={"a": Fraction(1)})


def test_stretches_in_tasks(spark):
    """Many stretches: slots without gaps, exact shares, a rare source, one of weight 0."""
    df = spark.range(24_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id < 3 THEN 'rare' WHEN id < 10 THEN 'none' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    weights = {"a": Fraction(2, 3), "b": Fraction(1, 3) - Fraction(1, 3000), "rare": Fraction(1, 3000), "none": Fraction(0)}
    got = mixed(df, weights=weights, block=1).select("doc_id", "_source", "_slot").orderBy("_slot").collect()
    assert [r._slot for r in got] == list(range(len(got))) and len(got) > 30 * 1024
    assert len({r.doc_id for r in got}) == 24_000 - 7
    done = Counter()
    for n, r in enumerate(got, 1):
        done[r._source] += 1
        assert all(abs(done[s] - w * n) < 1 for s, w in weights.items())
    with pytest.raises(ValueError):
        mixed(df, weights={**weights, "none": Fraction(-1)})
