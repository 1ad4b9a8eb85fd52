"""Mixing sources to target weights by Pfair scheduling.

Time is counted in blocks.  A source of weight w, of all weights together, releases its
i-th block (from 0) at floor(i / w) and must have placed it by ceil((i + 1) / w), in
exact fractions over the whole mixture; at each slot the released block with the
earliest deadline is placed, ties by name.  As the weights add up to one, all deadlines
are met, so every source is less than one block from its exact weight at every slot,
however long the mixture and however small the weight.

What the schedule's rest depends on is the number of blocks that each source has placed.
The driver runs through the slots once and keeps these numbers at the starts of stretches
(``STATES`` numbers); tasks lay the stretches out again from there.  A mixture has ``SLOTS`` slots
at most, which bounds the driver's time: for larger ones blocks of twice as many
documents are taken until it does (below some 10^9 documents they stay as given).

The mixture ends when every source has placed all its documents once, so none is
lost; sources that are ahead by then have begun again and repeat documents.
Within a source, documents go by the MD5 of their id.  Their ranks are sums over hash
buckets of about ``BUCKET_ROWS`` documents of the largest source, so a source with most
of the rows is dealt over many tasks; documents meet the slots of their blocks by source
and bucket, as they lie for their ranks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 16
#: Slots of a mixture at most, and of a stretch at least.
SLOTS, STRETCH = 1 << 26, 4096
#: Numbers that the driver keeps of the stretches' starts: longer stretches where there are many sources or slots.
STATES = 1 << 18
#: Sources at most; their names and weights are what the driver holds.
SOURCES = 100_000
#: The columns that the mixture adds.
ADDED = ("_source", "_slot", "_place")
#: Documents of the largest source in a bucket, about, and hex digits of the buckets' own groups.
BUCKET_ROWS, GROUP_DIGITS = 2000, 3


def natural_weights(counts: dict[str, int], even: Fraction = Fraction(1, 10)) -> dict[str, Fraction]:
    """Nine parts of a source's share of the rows and one part of an equal share."""
    total, n = sum(counts.values()), len(counts)
    return {s: (1 - even) * Fraction(c, total) + even * Fraction(1, n) for s, c in counts.items()}


class Schedule:
    """Earliest deadline first among released blocks, slot by slot, from the numbers of blocks placed before ``slot``."""

    def __init__(self, weights: dict[str, Fraction], slot: int = 0, placed: list[int] | None = None):
        self.names = sorted(weights)
        exact = [Fraction(weights[s]) for s in self.names]
        if min(exact) <= 0:
            raise ValueError("weights must be more than 0")
        parts = math.lcm(*(w.denominator for w in exact))
        self.share = [int(w * parts) for w in exact]
        self.whole = sum(self.share)
        self.slot, self.placed = slot, list(placed) if placed is not None else [0] * len(exact)
        self.waiting = [(i * self.whole // x, k) for k, (i, x) in enumerate(zip(self.placed, self.share))]
        heapq.heapify(self.waiting)
        self.ready: list[tuple[int, int]] = []

    def next(self) -> int:
        """The number by name of the source that has the slot; its block is the one after those placed."""
        waiting, ready, whole = self.waiting, self.ready, self.whole
        while waiting and waiting[0][0] <= self.slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(self.placed[k] + 1) * whole // self.share[k]), k))
        deadline, k = heapq.heappop(ready)
        assert self.slot < deadline
        self.placed[k] += 1
        self.slot += 1
        heapq.heappush(waiting, (self.placed[k] * whole // self.share[k], k))
        return k


def block_size(weights: dict[str, Fraction], counts: dict[str, int], block: int, slots: int = SLOTS) -> int:
    """``block``, doubled until the mixture has at most ``slots`` slots."""
    total = sum(weights.values())
    while max(-(-counts[s] // block) * total / w for s, w in weights.items()) > slots and block < max(counts.values()):
        block *= 2
    return block


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ranked(docs: DataFrame, source: str, digits: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_source, _bucket, _local``, and ``_source, _bucket, _n, _before`` of the buckets.

    A document's rank in its source, from 0, by the MD5 of its id, is ``_before + _local``.
    Rows of equal id go by text.  Buckets are summed within groups, and groups within sources.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = docs.withColumns({"_source": _source(source), "_key": key}).withColumn("_bucket", F.substring("_key", 1, digits))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    local = named.withColumn("_local", F.row_number().over(within) - 1).drop("_key")
    sizes = docs.select(_source(source).alias("_source"), F.substring(key, 1, digits).alias("_bucket")).groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_group", F.substring("_bucket", 1, GROUP_DIGITS))
    groups = sizes.groupBy("_source", "_group").agg(F.sum("_n").alias("_all"))
    groups = groups.select("_source", "_group", (F.sum("_all").over(Window.partitionBy("_source").orderBy("_group")) - F.col("_all")).alias("_first_of"))
    before = F.sum("_n").over(Window.partitionBy("_source", "_group").orderBy("_bucket")) - F.col("_n")
    sizes = sizes.withColumn("_before", before).join(groups, ["_source", "_group"])
    return local, sizes.select("_source", "_bucket", "_n", (F.col("_before") + F.col("_first_of")).alias("_before"))


Start = tuple[int, int, list[int]]


def planned(weights: dict[str, Fraction], blocks: dict[str, int], states: int = STATES) -> tuple[list[Start], dict[str, int], int]:
    """The slots until every source has placed ``blocks`` blocks.

    Returns the starts of stretches (first slot, end, what each source has placed), the
    blocks placed in all, and the number of slots.
    """
    run, step = Schedule(weights), STRETCH
    missing = sum(blocks.values())
    asked = [blocks[s] for s in run.names]
    starts: list[tuple[int, list[int]]] = []
    while missing > 0:
        if run.slot % step == 0:
            starts.append((run.slot, list(run.placed)))
            if len(starts) > 1 and len(starts) * len(asked) > states:
                starts, step = starts[::2], 2 * step
        k = run.next()
        missing -= run.placed[k] <= asked[k]
    ends = [x[0] for x in starts[1:]] + [run.slot]
    return [(slot, end, had) for (slot, had), end in zip(starts, ends)], dict(zip(run.names, run.placed)), run.slot


def laid_out(weights: dict[str, Fraction], start: Start) -> Iterator[tuple[str, int, int]]:
    """(source, its block, slot) for the slots of a stretch."""
    first, end, placed = start
    run = Schedule(weights, first, placed)
    for slot in range(first, end):
        k = run.next()
        yield run.names[k], run.placed[k] - 1, slot


def schedule(spark: SparkSession, weights: dict[str, Fraction], starts: list[Start]) -> DataFrame:
    """``_source, _which, _slot`` for every block of the mixture, laid out in tasks by stretch."""
    names = ["_source", "_which", "_slot"]

    def lay(batches):
        for batch in batches:
            for start in zip(*(c.to_pylist() for c in batch.columns)):
                rows = laid_out(weights, start)
                while part := [r for _, r in zip(range(STRETCH), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))], names=names)

    tasks = min(len(starts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spark.createDataFrame(starts, "first long, end long, placed array<long>").repartition(tasks, "first")
    return dealt.mapInArrow(lay, "_source string, _which long, _slot long")


def mixed(docs: DataFrame, source: str = "source", weights: dict[str, Fraction] | None = None, block: int = BLOCK) -> DataFrame:
    """The mixture: all columns of ``docs`` with ``_source, _slot, _place``, a row for each time a document is placed.

    ``_slot`` is the block's place in the mixture and ``_place`` the document's in
    the block; columns of ``docs`` with these three names are replaced.  A null
    source is the source ''.  ``weights`` maps each source to its part (missing ones
    and negative ones: an error); by default ``natural_weights``.  A source of weight
    0 has no place in the mixture.  The mixture is as long as the source with the
    most documents for its weight asks.  Rows of equal id and text are rows of their
    own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = {c: "_own" + c for c in docs.columns if c.startswith("_")}
    names = [c for c in docs.columns if c not in ADDED]
    docs, source = docs.withColumnsRenamed(own), own.get(source, source)
    rows = docs.groupBy(_source(source).alias("s")).agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: name them by fewer labels")
    counts = {r.s: r.n for r in rows}
    if weights is not None and (missing := set(counts) - set(weights)):
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    given = natural_weights(counts) if weights is None else {s: weights[s] for s in counts}
    if any(w < 0 for w in given.values()):
        raise ValueError("weights must not be negative")
    given = {s: w for s, w in given.items() if w}
    block = block_size(given, counts, block) if given else block
    starts, placed, last = planned(given, {s: -(-counts[s] // block) for s in given}) if given else ([], {}, 0)
    slots = schedule(spark, given, starts) if starts else spark.createDataFrame([], "_source string, _which long, _slot long")
    # a row for each source, as the weights have
    heads = spark.createDataFrame([(s, counts[s], placed[s]) for s in sorted(given)], "_source string, _count long, _blocks long")
    digits = max(GROUP_DIGITS, math.ceil(math.log(max(counts.values(), default=1) / BUCKET_ROWS, 16)))
    local, buckets = ranked(docs, source, digits)
    # each time that a bucket comes round, its first document's number in the source's stream and its blocks' slots
    again = F.floor((F.col("_blocks") * block - 1 - F.col("_before")) / F.col("_count"))
    passes = buckets.join(heads, "_source").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), again)))
    passes = passes.withColumn("_from", F.col("_before") + F.col("_pass") * F.col("_count")).withColumn("_first", F.floor(F.col("_from") / block))
    end = F.least(F.floor((F.col("_from") + F.col("_n") - 1) / block), F.col("_blocks") - 1)
    wanted = passes.select("_source", "_bucket", "_from", "_first", F.explode(F.sequence("_first", end)).alias("_which"))
    found = wanted.join(slots, ["_source", "_which"])
    found = found.groupBy("_source", "_bucket", "_from", "_first").agg(F.sort_array(F.collect_list(F.struct("_which", "_slot"))).alias("_at"))
    out = local.join(found, ["_source", "_bucket"]).withColumn("_nth", F.col("_from") + F.col("_local"))
    out = out.withColumns({"_slot": F.get("_at", F.floor(F.col("_nth") / block) - F.col("_first"))["_slot"], "_place": F.col("_nth") % block})
    return out.where(F.col("_slot").isNotNull()).select(*[F.col(own.get(c, c)).alias(c) for c in names], *ADDED)
