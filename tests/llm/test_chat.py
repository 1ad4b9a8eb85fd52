"""Round trips and budgets of chat windows."""

import hashlib

from tendril.llm.chat import BUDGET, read_back, turn_tokens, windows

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    rows = [
        (
            1, 0, "system", "Be ~0 brief </s>[INST]", "x"
        ), (1, 1, "user", "~1 <s> hi\n", "x"), (1, 2, "assistant", "[/INST] ok ~", "x"), (2, 0, "assistant", None, "x"), (2, 0, "user", "é" * 5000, "x"), (2, 1, "assistant", "a", "x"), (2, 1, "assistant", "a", "x"),
        (3, None, None, "", "x"), (4, 0, "a\n~n", "<<s>/s></s></s>", "x"), (None, 1, "user", "n", "x"),
    ] + [
        (5, k, "user" if k % 2 else "assistant", "word " * 60 + str(k), "x") for k in range(40)
    ] + [(6, 0, "system", "s" * 400, "x")] + [(6, k, "assistant", "t" * 300 + str(k), "x") for k in range(1, 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = windows(df)
    got = {r.conv_id: r for r in read_back(w).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        lost = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(said), len(lost), sha(lost))
    six = sorted((x for x in w.collect() if x.conv_id == 6), key=lambda x: x.window)
    assert len(six) > 2 and all(x.formatted.startswith("<s>system\n") for x in six) and all(x.n_repeated >= 1 for x in six[1:])
    assert all(len(x.formatted) / 4 <= BUDGET + 40 for x in six)


def test_empty_and_native(spark):
    w = windows(spark.createDataFrame([], SCHEMA))
    assert read_back(w).count() == 0
    plan = read_back(w)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_tokens_are_estimated(spark):
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([("",), ("abcd",), ("abcde",)], "t string").select(turn_tokens(F.col("t"))).collect()] == [4, 5, 6]


def test_long_conversation_and_null_ids(spark):
    """Tens of thousands of turns, of which each is looked at once; rows without an id are one conversation."""
    from pyspark.sql import functions as F

    long = spark.range(30_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("turn "), F.col("id")).alias("text")
    )
    none = spark.createDataFrame([(None, 2, "assistant", "b"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    w = windows(long.unionByName(none))
    assert "RangeFrame" not in w._jdf.queryExecution().analyzed().toString()
    got = {r.conv_id: r for r in read_back(w).collect()}
    assert got[1].n_turns == 30_000 and got[1].turns_sha256 == sha("".join(f"{'assistant' if k % 2 else 'user'}\nturn {k}\n" for k in range(30_000)))
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("user\na\nassistant\nb\n")
