"""Jaccard self-join of documents' word n-grams, and the components of its links.

A set's elements are put in one global order, frequent ones last, and a set enters
the index lists of its first elements only (prefix filter).  The lists are sorted
by set size and position and compared in blocks; a block whose sizes or positions
rule out enough common elements is skipped whole.  Pairs that remain must share
enough of their prefixes, and only then are whole sets fetched and compared.

Relations between sets save the rest.  Equal sets are one set.  The first rounds
compare neighbours in the lists, which joins most near copies of a text into
components; each component has a leader, and for every other set in it the elements
that it has and the leader lacks are counted.  From then on a leader stands for its
members, those that have few such elements (``CLOSE``): they enter the lists only of those prefix elements that the leader's prefix
lacks, and all else about them is derived from the leader's answers.  When a
leader S and a set X have been compared, a member R of S's component shares with X
|S & X| + |R - S| elements at most; members that could still link by that, and only
they, are compared with X, and what that gives bounds what they share with X's own
members.  The same holds on the other side.  Sets of one component are not compared at all, so no link between components can be missed, and
links within them need not be found.

A list of more than ``LIST`` sets is dealt as pairs of its parts.  Very frequent
shingles are last in every set's order, so a list is long only if very many
different texts consist of such shingles almost wholly.  Order, hashes and rounds
only decide what is compared; links are decided by counting 64-bit hashes of
shingles in the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.components import components
from tendril.llm.shared import classed, dealt, small_batches, stored

SIZE = 5
#: The threshold as a fraction: 100 * intersection >= 75 * union.
PART, WHOLE = 75, 100
#: Frequent shingles that the order knows by count; the others go by hash.
FREQUENT = 1 << 16
#: Shingles that a task gathers before it counts them.
BUFFER = 1_000_000
LEAST_COUNT = 3
LIST = 512
#: Members of a component that meet their leader in one task.
MEMBERS = 256
#: A member is highly similar to its leader if it has at most one in so many elements that the leader lacks.
CLOSE = 40
_BLOCK = 64
#: A number of elements that no set has: where a bound says nothing.
_ANY = 1 << 40
#: What an entry of a list stands for: its own set alone; a component, by its leader; a member, where its leader is not in the list.
ALONE, LEADER, MEMBER = 0, 1, 2

POSTING = "tok long, doc_id long, n int, pos int, sig long"


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) for each text; a text of fewer words is one shingle."""
    data, at = K.strings(column)
    for i, j in K.slices(at):
        text = K.words(data, at[i : j + 1], K.SPACED, True)
        h = text.hashes()
        g = K.grams(h, size)
        for k in range(j - i):
            a, b = int(text.first[k]), int(text.first[k + 1])
            if b - a >= size:
                yield i + k, np.unique(g[a : b - size + 1])
            elif b > a:
                yield i + k, K.grams(np.concatenate([[np.uint64(b - a)], h[a:b]]), b - a + 1)
            else:
                yield i + k, np.zeros(0, dtype=np.uint64)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def frequent_shingles(docs: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and ranks by count of shingles that many documents hold.

    Tasks count everything they read, buffer by buffer, and send what occurs
    ``LEAST_COUNT`` times in a buffer; the order built from it may be any, so the
    list may end at ``FREQUENT``.
    """

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= LEAST_COUNT
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["tok", "n"])

    def rows(batches):
        held, total = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(1), size):
                held.append(s)
                total += len(s)
                if total >= BUFFER:
                    yield counts(held)
                    held, total = [], 0
        if held:
            yield counts(held)

    top = _text(docs).mapInArrow(rows, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tok").limit(FREQUENT).toPandas()
    tok = top["tok"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tok)
    rank = np.empty(len(tok), dtype=np.int64)
    rank[:] = len(tok) - np.arange(len(tok))  # the most frequent is last of all
    return tok[order], rank[order]


def prefix_size(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first elements of a set in the global order: rare ones by hash, then frequent ones by count."""
    p = prefix_size(len(s))
    if not len(frequent):
        return s[:p]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often][:p]
    if len(rare) == p:
        return rare
    late = s[often]
    return np.concatenate([rare, late[np.argsort(rank[at[often]], kind="stable")][: p - len(rare)]])


def _signature(s: np.ndarray) -> tuple[int, int]:
    """A hash of the set as a signed 64-bit number, and 30 more bits."""
    with np.errstate(over="ignore"):
        whole = K.mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], dtype=np.uint64))
        both = K.mix(np.array([whole[0] ^ (whole[1] * np.uint64(3)), whole[1]], dtype=np.uint64))
    return int(both.view(np.int64)[0]), int(both[1] >> np.uint64(34))


def _posting_rows(frequent: np.ndarray, rank: np.ndarray, size: int) -> Callable:
    """A row per document (``pos`` below 0) and one for each element of its prefix; copies within a batch send one prefix."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            order = np.argsort(ids, kind="stable")
            batch = batch.take(pa.array(order))
            ids = ids[order]
            seen: set[tuple[int, int, int]] = set()
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            held = 0

            def flush():
                arrays = [np.concatenate(x) for x in out]
                for x in out:
                    x.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(arrays[0]), pa.array(arrays[1]), pa.array(arrays[2].astype(np.int32)), pa.array(arrays[3].astype(np.int32)), pa.array(arrays[4])],
                    names=["tok", "doc_id", "n", "pos", "sig"]
                )

            for k, s in shingle_sets(batch.column(1), size):
                n, doc = len(s), int(ids[k])
                sig, more = _signature(s) if n else (0, 0)
                own = [np.array([doc], dtype=np.int64), np.array([doc]), np.array([n]), np.array([-1 - more]), np.array([sig])]
                own[0] = K.mix(own[0].view(np.uint64)).view(np.int64)
                if n and (n, sig, more) not in seen:
                    seen.add((n, sig, more))
                    p = prefix(s, frequent, rank)
                    m = len(p)
                    own = [np.concatenate(x) for x in zip(own, (p.view(np.int64), np.full(m, doc), np.full(m, n), np.arange(m), np.full(m, sig)))]
                for x, y in zip(out, own):
                    x.append(y)
                held += len(own[0])
                if held >= 100_000:
                    yield flush()
                    held = 0
            if held:
                yield flush()

    return rows


def _lists_of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``tok, n, pos, sig, doc_id``: document rows, and postings of elements that two different sets hold."""
    held: pa.RecordBatch | None = None  # the last posting, if it is alone so far
    last: tuple[int, int, int, int] | None = None  # its tok, n, pos, sig
    shared = False  # and whether its list has another set before it
    for batch in batches:
        if not batch.num_rows:
            continue
        tok, n, pos, sig = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
        docs = pos < 0
        if docs.any():
            yield batch.filter(pa.array(docs))
        at = np.flatnonzero(~docs)
        if not len(at):
            continue
        cols = np.stack([tok[at], n[at].astype(np.int64), pos[at].astype(np.int64), sig[at]])
        before = np.concatenate([np.array(last, dtype=np.int64)[:, None] if last else np.full((4, 1), -1), cols[:, :-1]], axis=1)
        new_list = cols[0] != before[0]
        if last is None:
            new_list[0] = True
        copy = (cols == before).all(axis=0) & ~new_list  # the same set again
        at, new_list = at[~copy], new_list[~copy]
        if not len(at):
            continue
        joins = ~new_list  # another set of the same list stands before
        next_joins = np.append(joins[1:], False)
        if held is not None:
            if joins[0]:
                yield held
            held = None
        keep = joins | next_joins
        if not keep[-1]:
            held = batch.slice(int(at[-1]), 1)
        k = at[keep]
        if len(k):
            yield batch.take(pa.array(k))
        last = tuple(int(c) for c in (tok[at[-1]], n[at[-1]], pos[at[-1]], sig[at[-1]]))


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements that sets of sizes ``a`` and ``b`` need."""
    return -(-PART * (a + b) // (PART + WHOLE))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of list neighbours whose sizes let them link, from rows ``tok, doc_id, n, pos, c`` in list order; none of one ``c``."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
        if last is not None:
            cols = np.concatenate([last, cols], axis=1)
        last = cols[:, -1:]
        a, b = cols[:, :-1], cols[:, 1:]
        low, high = np.minimum(a[2], b[2]), np.maximum(a[2], b[2])
        k = np.flatnonzero((a[0] == b[0]) & (a[4] != b[4]) & (WHOLE * low >= PART * high))
        if len(k):
            yield _pairs(a[1, k], b[1, k], a[2, k], b[2, k])


def _pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    swap = a > b
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, nb, na)), pa.array(np.where(swap, na, nb))],
        names=["a", "b", "na", "nb"]
    )


PAIR = "a long, b long, na long, nb long"


#: Bits of the bitmap of a prefix's shared elements, in 64-bit words.
BITMAP = 8
#: Lists up to this length are compared row by row at each distance, all of a batch at once.
_SHORT = 16


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, toks`` with the number of elements ``m`` and their bitmap."""
    for batch in batches:
        toks = batch.column(1)
        m = np.asarray(toks.value_lengths()).astype(np.int64)
        bit = (K.mix(toks.flatten().to_numpy().view(np.uint64)) % np.uint64(64 * BITMAP)).astype(np.int64)
        row = np.repeat(np.arange(len(m)), m)
        bits = np.zeros((len(m), BITMAP), dtype=np.uint64)
        np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        packed = pa.array([x.tobytes() for x in bits], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), toks, pa.array(m), packed], names=["doc_id", "toks", "m", "bits"])


ENTRY = ("tok", "cell", "half", "n", "pos", "doc_id", "c", "m", "low", "high", "slack", "kind")


class Cells:
    """Rows of cells with their prefixes' bitmaps.

    ``low`` and ``high`` are the least and greatest sizes of the sets that an entry
    stands for, ``slack`` the most elements that one of them has and the entry's
    own set lacks.  ``before`` and ``after`` count elements by the entry's position;
    they bound nothing where it stands for others, or not for all of its prefix.
    """

    def __init__(self, cols: dict[str, np.ndarray], bits: np.ndarray):
        self.cols, self.bits = cols, bits
        self.__dict__.update(cols)

    def __len__(self) -> int:
        return len(self.bits)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Cells:
        cols = {name: batch.column(k).to_numpy().astype(np.int64) for k, name in enumerate(ENTRY)}
        alone = cols["kind"] == ALONE
        cols["before"], cols["after"] = np.where(alone, cols["pos"], _ANY), np.where(alone, cols["n"] - cols["pos"], _ANY)
        data, at = K.strings(batch.column(len(ENTRY)))
        return cls(cols, np.frombuffer(data[at[0] : at[-1]].tobytes(), dtype=np.uint64).reshape(-1, BITMAP))

    def take(self, k) -> Cells:
        return Cells({name: x[k] for name, x in self.cols.items()}, self.bits[k])

    def after_rows(self, held: Cells | None) -> Cells:
        return self if held is None else Cells({name: np.concatenate([held.cols[name], x]) for name, x in self.cols.items()}, np.concatenate([held.bits, self.bits]))


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _could_link(p: Cells, q: Cells) -> Found:
    """Of entries side by side, those whose sets may link: ids, prefix elements that must be shared, whether lists count them, whether this may be the first."""
    need = least_common(p.low, q.low)
    room = np.minimum(p.after, q.after)
    # what stands before this element in both, and what stands from it on: true at every common element of a pair that links
    k = np.flatnonzero((WHOLE * p.high >= PART * q.low) & (WHOLE * q.high >= PART * p.low) & (p.c != q.c) & (np.minimum(p.before, q.before) + room >= need))
    # a bit that one prefix lacks is an element that it lacks, so this is no less than what the prefixes share
    a, b = p.bits[k], q.bits[k]
    common = np.minimum(p.m[k] - np.bitwise_count(a & ~b).sum(axis=1), q.m[k] - np.bitwise_count(b & ~a).sum(axis=1))
    beyond = -(-PART * np.maximum(p.n[k], q.n[k]) // WHOLE) - 1
    lack = need[k] - beyond - p.slack[k] - q.slack[k]
    fit = common >= lack
    k = k[fit]
    return p.doc_id[k], q.doc_id[k], lack[fit], (p.kind[k] != MEMBER) & (q.kind[k] != MEMBER), room[k] >= need[k]


POSSIBLE = "a long, b long, lack long, counted boolean, first boolean"


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the cells' entries that sizes, positions, prefixes and components leave."""
    held: Cells | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Cells.of(batch).after_rows(held)
        cut = np.flatnonzero((rows.tok[1:] != rows.tok[:-1]) | (rows.cell[1:] != rows.cell[:-1])) + 1
        edges = np.concatenate([[0], cut])
        held = rows.take(slice(int(edges[-1]), None))
        yield from _paired(rows, edges)
    if held is not None:
        yield from _paired(held, np.array([0, len(held)]))


def _paired(rows: Cells, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(edges)
    if not len(sizes):
        return
    parts: list[Found] = []
    group = np.repeat(np.arange(len(sizes)), sizes)
    short = np.flatnonzero((sizes[group] <= _SHORT) & (sizes[group] > 1))
    few, group = rows.take(short), group[short]
    for distance in range(1, _SHORT):
        k = np.flatnonzero(group[distance:] == group[:-distance])
        if not len(k):
            break
        parts.append(_could_link(few.take(k), few.take(k + distance)))
    for g in np.flatnonzero(sizes > _SHORT):
        parts.extend(_one_cell(rows.take(slice(int(edges[g]), int(edges[g + 1])))))
    parts = [x for x in parts if len(x[0])]
    if parts:
        a, b, lack, counted, first = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), lack, counted, first)], names=["a", "b", "lack", "counted", "first"])


def _one_cell(cell: Cells) -> Iterator[Found]:
    several = cell.half[0] != cell.half[-1]
    left = cell.take(cell.half == 0) if several else cell
    right = cell.take(cell.half == 1) if several else cell
    for x in range(0, len(left), _BLOCK):
        p = left.take(slice(x, x + _BLOCK))
        for y in range(0 if several else x, len(right), _BLOCK):
            q = right.take(slice(y, y + _BLOCK))
            # blocks ascend by least size: what they could share at most against what they need at least
            if WHOLE * p.high.max() < PART * q.low[0]:
                break
            if WHOLE * q.high.max() < PART * p.low[0] or min(p.before.max(), q.before.max()) + min(p.after.max(), q.after.max()) < least_common(p.low[0], q.low[0]):
                continue
            fit = (WHOLE * p.high[:, None] >= PART * q.low) & (WHOLE * q.high >= PART * p.low[:, None]) & (p.c[:, None] != q.c)
            if not several and x == y:
                fit &= np.arange(len(p))[:, None] < np.arange(len(q))
            i, j = np.nonzero(fit)
            if len(i):
                yield _could_link(p.take(i), q.take(j))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``doc_id`` and the packed set of the documents that ``ids`` names."""

    def rows(batches):
        for batch in batches:
            packed = [s.astype("<u8").tobytes() for _, s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "s"])

    # ids come from a written table: Spark knows their size and broadcasts them below its threshold, else shuffles
    return _text(docs).join(ids, "doc_id", "left_semi").mapInArrow(rows, "doc_id long, s binary")


def _common(x: pa.Scalar, y: pa.Scalar) -> tuple[int, int, int]:
    """Elements that two packed sets share, and their sizes."""
    p, q = (np.frombuffer(v.as_py(), dtype="<u8") for v in (x, y))
    both = np.concatenate([p, q])
    both.sort()
    return int((both[1:] == both[:-1]).sum()), len(p), len(q)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, linked`` for every pair, from the whole sets."""

    def rows(batches):
        for batch in batches:
            got = [_common(x, y) for x, y in zip(batch.column(2), batch.column(3))]
            linked = [WHOLE * common >= PART * (p + q - common) for common, p, q in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.int64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "common", "linked"]
            )

    one = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    both = one.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long, common long, linked boolean")


def _derived(members: DataFrame, sets: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """``doc_id, c, n, only, extra`` for the members of components (``doc_id, c``) but their leaders ``c``.

    ``only`` counts the member's elements that the leader lacks, ``extra`` lists the
    prefix elements that the leader's prefix lacks.  A leader is copied for every
    ``MEMBERS`` members, so no task has to hold all of a large component.
    """

    def rows(batches):
        for batch in batches:
            only = []
            for x, y in zip(batch.column(2), batch.column(3)):
                common, n, _ = _common(x, y)
                only.append((n, n - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[k] for x in only], pa.int64()) for k in (0, 1)), batch.column(4)],
                names=["doc_id", "c", "n", "only", "extra"]
            )

    sizes = stored(members.groupBy("c").agg(F.count("*").alias("_n")), "leaders").withColumn("copies", F.ceil(F.col("_n") / MEMBERS).cast("long"))
    own = classed(members, sizes, ["c"], "_n", total).withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies"))).drop("copies")
    own = own.join(sets, "doc_id").join(shared.select("doc_id", "toks"), "doc_id", "left")
    of = lambda df, name: df.select(F.col("doc_id").alias("c"), F.col(df.columns[1]).alias(name))
    heads = sizes.select(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    ).join(of(sets, "cs"), "c").join(of(shared.select("doc_id", "toks"), "ctoks"), "c", "left")
    none = F.array().cast("array<long>")
    both = own.join(heads, ["c", "copy"]).select("doc_id", "c", "s", "cs", F.array_except(F.coalesce("toks", none), F.coalesce("ctoks", none)).alias("extra"))
    return both.mapInArrow(rows, "doc_id long, c long, n long, only long, extra array<long>")


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            n = [len(s) for _, s in shingle_sets(batch.column(0), size)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "n_shingles long")


def similar_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case.  The component is
    the smallest ``doc_id`` that links reach; documents without words stand alone.
    Rows of equal id are documents of their own, each with its text's answer.  Rows
    with a null id have their set's size and a null component, and link with nothing.
    """
    named = _text(docs)
    nameless = _sizes(docs.where(F.col("doc_id").isNull()), size).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).count():
        return _linked(named, size).unionByName(nameless)
    keyed = stored(named.select(F.monotonically_increasing_id().alias("_row"), "*"), "keyed")
    rows = stored(
        _linked(keyed.select(F.col("_row").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "_row").join(keyed.select("_row", "doc_id"), "_row"),
        "linked-rows"
    )
    least = stored(rows.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    whole = classed(rows, least, ["component_id"], "n", rows.count())
    return whole.select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(nameless)


def _linked(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for documents (``doc_id, text``) of distinct ids."""
    small_batches(docs.sparkSession)
    frequent, rank = frequent_shingles(docs, size)
    order = ["tok", "n", "pos", "sig", "doc_id"]
    in_lists = _text(docs).mapInArrow(_posting_rows(frequent, rank, size), POSTING).repartition("tok").sortWithinPartitions(*order)
    index = stored(in_lists.mapInArrow(_lists_of_several, POSTING), "index")
    members = index.where(F.col("pos") < 0).select("doc_id", "n", "pos", "sig")
    classes = stored(members.where(F.col("n") > 0).groupBy("n", "pos", "sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where(F.col("copies") > 1), "classes")
    lists = index.where(F.col("pos") >= 0).select("tok", "doc_id", "n", "pos")
    shared = stored(lists.groupBy("doc_id").agg(F.collect_list("tok").alias("toks")).mapInArrow(_bitmaps, "doc_id long, toks array<long>, m long, bits binary"), "shared")

    links: list[DataFrame] = []
    checked: list[DataFrame] = []
    sets: list[DataFrame] = []

    def several(known: DataFrame) -> DataFrame:
        """The lists that hold sets of several components."""
        open_ = known.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("tok")
        return known.join(open_, "tok", "left_semi")

    def judged(pairs: DataFrame) -> DataFrame:
        """The components of the links so far, after the pairs' whole sets are compared; a set is built once."""
        for old in checked:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs.select("a", "b"), "candidates")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        for have in sets:
            ids = ids.join(have.select("doc_id"), "doc_id", "left_anti")
        sets.append(stored(_sets(docs, stored(ids, "ids"), size), "sets"))
        got = stored(_compared(pairs, reduce(DataFrame.unionByName, sets)), "compared")
        checked.append(got)
        links.append(got.where("linked").select("a", "b"))
        return components(reduce(DataFrame.unionByName, links))

    # elements of a prefix that the other prefix lacks, and the rest of the larger set, bound what two sets share
    beyond = F.greatest(*(F.ceil(F.col(c) * PART / WHOLE) - 1 for c in ("na", "nb")))
    need = F.ceil((F.col("na") + F.col("nb")) * PART / (PART + WHOLE))
    # neighbours by size, in an order that is the same in every list, so that two sets are neighbours in most that hold both;
    # then by hash, in an order of each list's own, those that are not in one component yet
    found: DataFrame | None = None
    for by in (["n", "doc_id"], ["_h", "doc_id"]):
        known = lists.withColumn("c", F.col("doc_id"))
        if found is not None:
            known = lists.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
            known = several(known.select("tok", "doc_id", "n", "pos", "c"))
        dealt_out = known.withColumn("_h", F.xxhash64("tok", "doc_id")).repartition("tok").sortWithinPartitions("tok", *by)
        near = dealt_out.select("tok", "doc_id", "n", "pos", "c").mapInArrow(_neighbours, PAIR).distinct()
        near = near.join(shared.select(F.col("doc_id").alias("a"), F.col("toks").alias("ta")), "a").join(shared.select(F.col("doc_id").alias("b"), F.col("toks").alias("tb")), "b")
        found = judged(near.where(F.size(F.array_intersect("ta", "tb")) + beyond >= need))

    # what a set's answers tell of those like it: the leaders of components stand for their members
    inside = found.where(F.col("node") != F.col("component")).select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    derived = stored(_derived(inside, reduce(DataFrame.unionByName, sets), shared, found.count()), "derived")
    close = derived.where(F.col("only") * CLOSE <= F.col("n"))
    ranges = close.groupBy("c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("only").alias("slack"))
    none = F.lit(None)
    kind = F.when(F.col("only") * CLOSE <= F.col("n"), MEMBER).otherwise(ALONE)
    roles = derived.select("doc_id", "c", F.col("n").alias("low"), F.col("n").alias("high"), F.lit(0).cast("long").alias("slack"), kind.alias("kind"), "extra")
    roles = stored(
        roles.unionByName(ranges.select(F.col("c").alias("doc_id"), "c", "low", "high", "slack", F.lit(LEADER).alias("kind"), none.cast("array<long>").alias("extra"))),
        "roles"
    )
    entries = lists.join(roles, "doc_id", "left").where(F.coalesce(F.col("kind") != MEMBER, F.lit(True)) | F.array_contains("extra", F.col("tok")))
    n = F.col("n").cast("long")
    entries = entries.select(
        "tok", "doc_id", "n", "pos", F.coalesce("c", "doc_id").alias("c"), F.least(n, F.coalesce("low", n)).alias("low"), F.greatest(n, F.coalesce("high", n)).alias("high"),
        F.coalesce("slack", F.lit(0)).alias("slack"), F.coalesce("kind", F.lit(ALONE)).alias("kind"),
    )
    entries = stored(several(entries), "entries")
    # every pair that is left: prefixes must share enough, and one list must hold the pair's first common element
    cells = dealt(entries.join(shared.select("doc_id", "m", "bits"), "doc_id"), entries.groupBy("tok").agg(F.count("*").alias("_n")), ["tok"], "doc_id", LIST)
    cells = cells.repartition("tok", "cell").sortWithinPartitions("tok", "cell", "half", "low").select(*ENTRY, "bits")
    pairs = cells.mapInArrow(_cell_pairs, POSSIBLE).groupBy("a", "b").agg(
        F.count("*").alias("k"), F.max("lack").alias("lack"), F.min("counted").alias("counted"), F.max("first").alias("first")
    )
    pairs = stored(pairs.where(F.col("first") & (~F.col("counted") | (F.col("k") >= F.col("lack")))), "possible")
    found = judged(pairs)

    # members of components whose leaders were compared and do not link: what the leaders share bounds what they share
    groups = roles.where(F.col("kind") == LEADER).select("doc_id", "low", "slack")
    size_of = members.join(groups, "doc_id", "left").select(
        "doc_id", "n", F.least("n", F.coalesce("low", "n")).alias("low"), F.coalesce("slack", F.lit(0)).alias("slack"),
        F.col("slack").isNotNull().alias("group")
    )
    side = lambda x: size_of.select(F.col("doc_id").alias(x), *[F.col(c).alias(c + x) for c in ("n", "low", "slack", "group")])
    needed = lambda p, q: F.ceil((F.col(p) + F.col(q)) * PART / (PART + WHOLE))
    compared = reduce(DataFrame.unionByName, checked).where(~F.col("linked"))
    open_ = pairs.select("a", "b").join(compared.select("a", "b", "common"), ["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    open_ = stored(open_.where((F.col("groupa") | F.col("groupb")) & (F.col("common") + F.col("slacka") + F.col("slackb") >= needed("lowa", "lowb"))), "open")
    if open_.count():
        standing = close.select("c", "doc_id", "n", "only").unionByName(
            groups.join(members.select("doc_id", "n"), "doc_id").select(
                F.col("doc_id").alias("c"), "doc_id", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("only")
            )
        )

        def with_members(df: DataFrame, x: str) -> DataFrame:
            them = standing.select(F.col("c").alias(x), F.col("doc_id").alias("m" + x), F.col("n").alias("nm" + x), F.col("only").alias("only" + x))
            return df.join(them, x, "left").withColumns({"m" + x: F.coalesce("m" + x, x), "nm" + x: F.coalesce("nm" + x, "n" + x), "only" + x: F.coalesce("only" + x, F.lit(0))})

        def apart(df: DataFrame, x: str, y: str, known: DataFrame) -> DataFrame:
            """Rows whose sets ``x`` and ``y`` are in different components."""
            for s in (x, y):
                df = df.join(known.select(F.col("node").alias(s), F.col("component").alias("c" + s)), s, "left").withColumn("c" + s, F.coalesce("c" + s, s))
            return df.where(F.col("c" + x) != F.col("c" + y)).drop("c" + x, "c" + y)

        ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        # each member against the other leader: that is linear, and most components that belong together meet here
        one = with_members(open_, "a").where(F.col("common") + F.col("onlya") + F.col("slackb") >= needed("nma", "lowb"))
        two = with_members(open_, "b").where(F.col("common") + F.col("onlyb") + F.col("slacka") >= needed("nmb", "lowa"))
        found = judged(apart(ordered(one, "ma", "b").unionByName(ordered(two, "a", "mb")).distinct(), "a", "b", found))
        still = stored(apart(open_, "a", "b", found), "still-open")
        if still.count():
            # and members against members, where both leaders' answers leave room
            every = reduce(DataFrame.unionByName, checked)

            def with_common(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
                known = every.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("common").alias(name))
                return df.withColumns({"_x": F.least(x, y), "_y": F.greatest(x, y)}).join(known, ["_x", "_y"]).drop("_x", "_y")

            both = with_common(with_members(with_common(with_members(still, "a"), "ma", "b", "commona"), "b"), "a", "mb", "commonb")
            room = F.least(F.col("commona") + F.col("onlyb"), F.col("commonb") + F.col("onlya"))
            fits = (room >= needed("nma", "nmb")) & (WHOLE * F.least("nma", "nmb") >= PART * F.greatest("nma", "nmb"))
            found = judged(apart(ordered(both.where(fits), "ma", "mb").distinct(), "a", "b", found))

    total = members.count()
    by_class = classed(members, classes, ["n", "pos", "sig"], "copies", total).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")
    )
    reps = stored(by_class, "by-class")
    counts = stored(found.withColumnRenamed("node", "rep").join(reps.groupBy("rep").agg(F.count("*").alias("copies")), "rep"), "found")
    return classed(reps, counts, ["rep"], "copies", total).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, keep_nulls: bool = True) -> DataFrame:
    """The documents, all columns, one of each group that links join, directly or through others: that of the smallest id.

    Rows are told apart by a key of their own, from a written table, so ids may
    repeat (the text's hash decides, then any row).  Rows with a null id all stay,
    apart from the groups; without ``keep_nulls`` they are rows like others and come
    last in their group.  Documents without words stay.
    """
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    named = keyed.where(F.col("doc_id").isNotNull()) if keep_nulls else keyed
    found = _linked(named.select(F.col("_row").alias("doc_id"), "text"), size).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    best = named.select("_row", order.alias("_order")).join(found, "_row").groupBy("component_id").agg(F.min("_order").alias("_best"))
    kept = named.join(best.select(F.col("_best._row").alias("_row")), "_row", "left_semi")
    if keep_nulls:
        kept = kept.unionByName(keyed.where(F.col("doc_id").isNull()))
    return kept.select(*docs.columns)
