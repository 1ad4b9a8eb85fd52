"""Cheapest repair of damaged conversations by rank-convergence Viterbi.

A repaired conversation has the roles ``(s?(ua)+)?`` by their initials.  Each row is
kept (0), given the role that is due (1) or deleted (2; blank and repeated rows must
be), turns without text may be inserted anywhere (5), and a truncated row that is not
deleted adds 5.  Of the cheapest repairs the one whose initials of edits (D, I, K, R)
come first in ASCII is taken.

Rows are dealt by ranges of (conversation, turn) and cut into chunks of ``CHUNK`` rows,
so a conversation of any length is worked on in parallel.  The state after a row is one
of four: nothing yet, a system turn, a user turn, an assistant turn; what matters of the
rows to come is the vector of the four costs to go, and of it only the differences.
Every chunk first takes the vector at its end to be that of a conversation's end; then
passes run again those chunks whose successor's vector turned out to differ by more than
a constant, until none does.  With these vectors each chunk maps the four states that it
may be entered in to the state that it ends in; the maps are followed along each
conversation, and every chunk traces its edits from its own entry.  A conversation in
one chunk, as nearly all are, needs none of the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.llm.shared import Scratch, small_batches

CHUNK = 256
#: Fixed value: the white space of a blank text.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system, a user, an assistant turn.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_DUE = np.array([_USER, _USER, _ASSISTANT, _USER])
_FAR = 1 << 20
#: The cost to go at a conversation's end, inserts included.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_WORD = {_USER: "user", _ASSISTANT: "assistant"}
#: A row's code: the initial (0 other, 1 s, 2 u, 3 a), blank 4, truncated 8.
_BLANK, _CUT = 4, 8
CHUNKS = (
    "conv_id long, chunk long, sure boolean, first_turn long, last_turn long, turns_seen long, first_initial string, last_initial string, "
    "codes binary, copies array<long>, keys array<long>, marks array<long>, roles array<string>, texts array<string>"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with every twentieth or so of each kind of damage, by ``crc32(conv_id:turn) % 20``; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
        (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("_kind")
    ).where("_kind <> 0")
    kind = F.col("_kind")
    rows = rows.withColumns(
        {"text": F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(kind == 4, "user").otherwise(F.col("role"))}
    )
    return rows.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _step(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs to go before a row, for each of many conversations: ``after`` (n, 4), ``codes`` (n)."""
    more = np.where(codes & _CUT, TRUNCATED, 0)[:, None]
    best = np.minimum(after + DELETE, REROLE + more + after[:, _DUE])
    kind, more = codes & 3, more[:, 0]
    best[:, _NONE] = np.minimum(best[:, _NONE], np.where(kind == 1, more + after[:, _SYSTEM], _FAR + best[:, _NONE]))
    for state in range(4):
        due = _DUE[state]
        best[:, state] = np.where(kind == due, np.minimum(best[:, state], more + after[:, due]), best[:, state])
    user, assistant = best[:, _USER], best[:, _ASSISTANT]
    return np.stack([
        np.minimum(best[:, _NONE], np.minimum(INSERT + user, 2 * INSERT + assistant)), np.minimum(best[:, _SYSTEM], np.minimum(INSERT + user, 2 * INSERT + assistant)),
        np.minimum(user, INSERT + assistant), np.minimum(assistant, INSERT + user),
    ], axis=1)


def _padded(live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in live], dtype=np.int64)
    codes = np.zeros((len(live), int(sizes.max(initial=0))), dtype=np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.concatenate(live) if len(live) else []
    return codes, sizes


def _backward(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go before each row and at the end: (rows + 1, n, 4).  A chunk's own end is where its rows end."""
    costs = np.empty((codes.shape[1] + 1, len(sizes), 4), dtype=np.int64)
    costs[-1] = end
    for t in range(codes.shape[1] - 1, -1, -1):
        costs[t] = np.where((sizes > t)[:, None], _step(costs[t + 1], codes[:, t]), costs[t + 1])
    return costs


def _forward(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edits (D 0, K 2, R 3) and the inserts before each row (n, rows), least first, and the last states."""
    state, each = entry.copy(), np.arange(len(sizes))
    edits, inserts = np.zeros(codes.shape, dtype=np.int8), np.zeros(codes.shape, dtype=np.int8)
    for t in range(codes.shape[1]):
        here, after, kind = costs[t], costs[t + 1], codes[:, t] & 3
        more = np.where(codes[:, t] & _CUT, TRUNCATED, 0)
        going = sizes > t
        for _ in range(3):
            at, due = here[each, state], _DUE[state]
            deleted = going & (DELETE + after[each, state] == at)
            put = going & ~deleted & (INSERT + here[each, due] == at)
            to = np.where((state == _NONE) & (kind == 1), _SYSTEM, due)
            kept = going & ~deleted & ~put & ((kind == due) | (to == _SYSTEM)) & (more + after[each, to] == at)
            given = going & ~deleted & ~put & ~kept
            edits[kept, t], edits[given, t] = 2, 3
            inserts[put, t] += 1
            state = np.where(kept, to, np.where(put | given, due, state))
            going = put
            if not going.any():
                break
    return edits, inserts, state


def _less(vector: np.ndarray) -> np.ndarray:
    """A vector up to a constant."""
    return vector - vector.min(axis=-1, keepdims=True)


def _chunked(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        pending, opened, first = None, 0, True  # rows of the last conversation that wait, its chunks so far
        for batch, final in _with_last(batches):
            table = batch if pending is None else pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
            conv = table.column(0)
            ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(ids)]])
            bounds, sure = [], []
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                cuts = list(range(a, b, size))
                whole = len(cuts) == 1 and not (k == 0 and (first or opened)) and k < len(starts) - 1
                bounds += cuts
                sure += [whole] * len(cuts)
            open_at = len(ids) if final else bounds[-1]
            if not final:
                bounds.pop(), sure.pop()
            first = first and len(starts) == 1
            opened = (opened if len(starts) == 1 else 0) + sum(b >= starts[-1] for b in bounds)
            pending = None if final else table.slice(open_at)
            if bounds:
                yield _rows(table, np.array(bounds + [open_at], dtype=np.int64), sure, part, number)

    return cut


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held, False
        held = batch
    if held is not None:
        yield held, True


def _rows(table: pa.RecordBatch, bounds: np.ndarray, sure: list[bool], part: int, number) -> pa.RecordBatch:
    """Chunk rows of ``table``'s rows between ``bounds``."""
    conv, turn, role, text, code, copies, key, mark = table.columns
    a, b = bounds[:-1], bounds[1:]
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    value = turn.fill_null(0).to_numpy(zero_copy_only=False)
    fresh = known.copy()
    fresh[1:] &= ~(known[:-1] & (value[1:] == value[:-1]))
    fresh[a] = known[a]
    upto = np.concatenate([[0], np.cumsum(fresh)])
    has = np.concatenate([[0], np.cumsum(known)])
    some = has[b] > has[a]  # nulls come first, so the last row has the largest turn
    first = value[np.minimum(b - 1, b - (has[b] - has[a]))]
    codes = code.to_numpy(zero_copy_only=False).astype(np.uint8)
    initials = role.to_pylist()
    listed = lambda column: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), column)
    columns = [
        conv.take(pa.array(a)), pa.array([part * (1 << 33) + next(number) for _ in a], pa.int64()), pa.array(sure),
        pa.array(first, pa.int64(), mask=~some), pa.array(value[b - 1], pa.int64(), mask=~some), pa.array(upto[b] - upto[a], pa.int64()),
        pa.array([initials[k][:1] for k in a]), pa.array([initials[k][:1] for k in b - 1]),
        pa.array([codes[i:j].tobytes() for i, j in zip(a, b)], pa.binary()), listed(copies), listed(key), listed(mark), listed(role), listed(text),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CHUNKS.split(", ")])


def chunks(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows in chunks of up to ``size`` different rows of a conversation, in order; ``sure`` chunks are whole conversations.

    Equal rows are counted before they are dealt, so no number of copies lands in one task.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    core = F.btrim("text", F.lit(BLANKS))
    initial = _initial(F.col("role"))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code = code + F.when(core == "", _BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(_CUT)
    rows = rows.withColumns({"code": code.cast("byte"), "key": F.xxhash64("role", "text"), "mark": F.xxhash64(F.lit(7), "role", "text"), "_head": F.substring("text", 1, 32)})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_head")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "code", "copies", "key", "mark")
    return dealt.mapInArrow(_chunked(size), CHUNKS)


def _faults(codes: bytes, keys: list[int], marks: list[int], known: set) -> tuple[np.ndarray, np.ndarray]:
    """The codes, and which rows repeat an earlier one of the chunk or of the ``known`` ones."""
    seen, repeats = set(), np.zeros(len(codes), dtype=bool)
    for k, key in enumerate(zip(keys, marks)):
        repeats[k] = key in seen or key in known
        seen.add(key)
    return np.frombuffer(codes, dtype=np.uint8).astype(np.int64), repeats


def _live(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By chunk: the codes of its rows, which of them repeat, which are to be decided on."""
    columns = [batch.column(n).to_pylist() for n in ("codes", "keys", "marks", "known")]
    found = [_faults(c, k, m, {(x["key"], x["mark"]) for x in known or ()}) for c, k, m, known in zip(*columns)]
    return [c for c, _ in found], [r for _, r in found], [np.flatnonzero(((c & _BLANK) == 0) & ~r) for c, r in found]


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_END if x is None else x for x in batch.column("end").to_pylist()], dtype=np.int64).reshape(-1, 4)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's vector before its first row, and the states that its four entries lead to."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, _, live = _live(batch)
        padded, sizes = _padded([c[k] for c, k in zip(codes, live)])
        costs = _backward(padded, sizes, _ends(batch))
        exits = np.stack([_forward(padded, sizes, costs, np.full(len(sizes), s))[2] for s in range(4)], axis=1)
        lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (_less(costs[0]), exits)]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), *lists], names=["chunk", "head", "exits"])


def _entries(table: pa.Table) -> pa.Table:
    """The state in which each chunk of one conversation is entered."""
    table = table.sort_by("place")
    state, entries = _NONE, []
    for exits in table.column("exits").to_pylist():
        entries.append(state)
        state = exits[state]
    return pa.table({"chunk": table.column("chunk"), "entry": pa.array(entries, pa.int64())})


TRACED = "conv_id long, chunk long, first_turn long, last_turn long, turns_seen long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, repeats, live = _live(batch)
        padded, sizes = _padded([c[k] for c, k in zip(codes, live)])
        entry = batch.column("entry").fill_null(_NONE).to_numpy(zero_copy_only=False)
        costs = _backward(padded, sizes, _ends(batch))
        edits, inserts, _ = _forward(padded, sizes, costs, entry)
        ending = batch.column("end").is_null().to_pylist()
        lists = [batch.column(n).to_pylist() for n in ("roles", "texts", "copies")]
        out = []
        for k, (roles, texts, copies) in enumerate(zip(*lists)):
            out.append(_written(codes[k], repeats[k], live[k], edits[k], inserts[k], int(entry[k]), ending[k], roles, texts, copies))
        names = [f.split()[0] for f in TRACED.split(", ")]
        kept = [batch.column(n) for n in names[:7]]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(kept + [pa.array(list(x), t) for x, t in zip(zip(*out), types)], names=names)


def _written(codes, repeats, live, edits, inserts, state, ending, roles, texts, copies) -> tuple:
    """Counts, cost, edits and text of one chunk whose decisions are known."""
    decided = {int(k): (int(edits[j]), int(inserts[j])) for j, k in enumerate(live)}
    audit, said, cost, blank, duplicate, truncated, illegal = [], [], 0, 0, 0, 0, 0

    def insert(state: int) -> int:
        due = int(_DUE[state])
        audit.append("I")
        said.append(_WORD[due] + ":")
        return due

    for k, (role, text, many) in enumerate(zip(roles, texts, copies)):
        empty, cut = bool(codes[k] & _BLANK), bool(codes[k] & _CUT)
        if empty:
            blank += many
        else:
            duplicate += many - (not repeats[k])
            truncated += cut and not repeats[k]
        illegal += many - 1 + (k > 0 and roles[k - 1][:1] + role[:1] not in ("su", "ua", "au"))
        edit, put = decided.get(k, (0, 0))
        for _ in range(put):
            state = insert(state)
        cost += INSERT * put
        if edit == 0:
            audit.append("D" * many)
            cost += DELETE * many
            continue
        system = edit == 2 and state == _NONE and role[:1] == "s"
        state = _SYSTEM if system else int(_DUE[state])
        said.append((_WORD[state] if edit == 3 else role) + ":" + text)
        audit.append("KR"[edit - 2] + "D" * (many - 1))
        cost += (REROLE if edit == 3 else 0) + TRUNCATED * cut + DELETE * (many - 1)
    while ending and state in (_SYSTEM, _USER):
        state = insert(state)
        cost += INSERT
    return blank, duplicate, truncated, illegal, cost, "".join(audit), "\n".join(said) if said else None


def repaired(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    ``repaired`` holds a line ``role:text`` for each row that is left.  Rows are taken
    by turn (nulls first), those of equal turn by role and text; null roles and texts
    are one space, null ids make one conversation, repeated rows are duplicates.
    ``gaps`` counts the turns between the first and the last that no row has.  Only
    ``conv_id, turn, role, text`` are read.  An empty table gives no rows.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    found = scratch.kept(chunks(conversations, size), "chunks")
    unsure = found.where(~F.col("sure"))
    ids = Window.partitionBy("conv_id").orderBy("chunk")
    placed = unsure.select("conv_id", "chunk").withColumns({"place": F.row_number().over(ids), "next": F.lead("chunk").over(ids)})
    placed = scratch.stored(placed.withColumn("_n", F.max("place").over(Window.partitionBy("conv_id"))).where("_n > 1").drop("_n"), "places")
    columns = ["codes", "keys", "marks"]
    extra = found.select(
        "*", F.lit(None).cast("array<struct<key: bigint, mark: bigint>>").alias("known"), F.lit(None).cast("array<bigint>").alias("end"),
        F.lit(None).cast("bigint").alias("entry")
    )
    if not placed.isEmpty():
        long = scratch.stored(unsure.join(placed.drop("conv_id"), "chunk").select("conv_id", "chunk", "place", "next", *columns), "long")
        key = F.explode(F.array_distinct(F.arrays_zip("keys", "marks")))
        keys = scratch.stored(
            long.select("conv_id", "chunk", key.alias("x")).select("conv_id", "chunk", F.col("x")["keys"].alias("key"), F.col("x")["marks"].alias("mark")),
            "keys"
        )
        twice = keys.groupBy("conv_id", "key", "mark").agg(F.min("chunk").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        twice = twice.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), F.col("mark").alias("_mark"), "least")
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")) & (F.col("mark") == F.col("_mark")) & (F.col("chunk") > F.col("least"))
        known = scratch.stored(keys.join(twice, same).groupBy("chunk").agg(F.collect_list(F.struct("key", "mark")).alias("known")), "known")
        long = scratch.stored(long.join(known, "chunk", "left"), "faults")
        run = lambda rows: rows.select("chunk", *columns, "known", "end").mapInArrow(_heads, "chunk long, head array<long>, exits array<long>")
        ends = long.select("chunk", "next", F.when(F.col("next").isNotNull(), F.array(*map(F.lit, _END.tolist()))).alias("end"))
        state = scratch.stored(ends.join(run(long.join(ends.drop("next"), "chunk")), "chunk"), "vectors")
        while True:
            after = state.select(F.col("chunk").alias("next"), F.col("head").alias("_after"))
            both = state.join(after, "next", "left")
            late = scratch.stored(both.where(F.col("_after").isNotNull() & (F.col("_after") != F.col("end"))).select("chunk", "next", F.col("_after").alias("end")), "late")
            if late.isEmpty():
                break
            again = late.join(run(long.join(late.drop("next"), "chunk")), "chunk")
            state = scratch.stored(state.join(late.select("chunk"), "chunk", "left_anti").unionByName(again), "vectors")
        maps = state.join(placed.select("conv_id", "chunk", "place"), "chunk")
        entries = maps.groupBy("conv_id").applyInArrow(_entries, "chunk long, entry long")
        plan = scratch.kept(state.select("chunk", "end").join(entries, "chunk").join(known, "chunk", "left"), "plan")
        extra = found.where("sure").select(
            "*",
            *[F.lit(None).cast(t).alias(n) for n, t in (("known", "array<struct<key: bigint, mark: bigint>>"), ("end", "array<bigint>"), ("entry", "bigint"))]
        )
        extra = extra.unionByName(unsure.join(plan, "chunk", "left"))
    scratch.clear()
    traced = extra.mapInArrow(_traced, TRACED)
    before = Window.partitionBy("conv_id").orderBy("chunk")
    traced = traced.withColumns({
        "_initial": F.lag("last_initial").over(before),
        "_turn": F.lag("last_turn").over(before),
        "_piece": F.struct("chunk", "audit", "repaired"),
    })
    joined = F.col("_initial").isNotNull() & ~F.concat("_initial", "first_initial").isin("su", "ua", "au")
    pieces = lambda name, by: F.array_join(F.transform(F.col("_pieces"), lambda x: x[name]), by)
    whole = traced.groupBy("conv_id").agg(
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns_seen") - F.when(F.col("_turn") == F.col("first_turn"), 1).otherwise(0))).alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + joined.cast("long")).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list("_piece")).alias("_pieces"),
    )
    return whole.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        pieces("audit", "").alias("audit"), pieces("repaired", "\n").alias("repaired")
    )
