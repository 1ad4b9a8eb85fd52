"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of every benchmark
item (an item with fewer words is one window).  Patterns of one length form a
matcher: the shift table says for each block of words how far the search may
jump, blocks that end a pattern lead to a bucket of patterns by the hash of that
suffix, and the words are compared before an occurrence counts.  The search runs
many stretches of text side by side, so that each step is one array operation.

The tables are arrays that tasks build and write to the shared folder, in parts of
``MOST_TABLE_BYTES`` as counted before; a task that searches reads one part.  The
driver handles their paths only.  A benchmark of several parts is searched part by
part, and the parts' hits are merged by a key that each row gets for this, from a
written table, as ids may be null or repeat.  The documents are scanned where they
lie: there is no shuffle while the benchmark fits one part, and none for filtering
in any case.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.shared import opened, shared_path, small_batches, stored

WINDOW = 10
#: Bytes of the tables of one part of the benchmark; each worker that searches holds one part.
MOST_TABLE_BYTES = 256 << 20
#: Bytes that a word of the benchmark takes in the tables, with its share of the shift table, besides its own.
_WORD_BYTES = 40
_LANE = 512

SCHEMA = "doc_id long, n_words long, hits array<struct<first: int, last: int>>, items array<string>"


class Matcher:
    """Wu-Manber tables for patterns of one length, in words, as arrays over the part's words."""

    def __init__(self, arrays: dict[str, np.ndarray], part: Part):
        self.shift, self.bucket, self.at, self.owner = (arrays[k] for k in ("shift", "bucket", "at", "owner"))
        self.length, self.bits = (int(x) for x in arrays["shape"])
        self.block, self.part = min(2, self.length), part

    @classmethod
    def build(cls, hashes: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int, part: Part) -> Matcher:
        """For the patterns that begin at words ``at`` of items ``owner``; one that an item holds twice counts once."""
        whole, more = ((K.grams(h, length) if length > 1 else K.mix(h))[at] for h in (hashes, hashes ^ np.uint64(1)))
        order = np.lexsort((at, owner, more, whole))  # the buckets, by the hash of the words that end here
        whole, more, at, owner = whole[order], more[order], at[order], owner[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (whole[1:] != whole[:-1]) | (more[1:] != more[:-1]) | (owner[1:] != owner[:-1])
        bits = min(24, max(18, len(at).bit_length() + 2))
        self = cls(
            {"shift": np.zeros(0), "bucket": whole[fresh], "at": at[fresh].astype(np.int32), "owner": owner[fresh].astype(np.int32), "shape": np.array([length, bits])},
            part
        )
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.uint8 if length < 256 else np.int32)
        for end in range(self.block, length + 1):
            words = np.stack([hashes[self.at + end - self.block + k] for k in range(self.block)], axis=-1)
            np.minimum.at(self.shift, self.slot(words), self.shift.dtype.type(length - end))
        return self

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shift": self.shift, "bucket": self.bucket, "at": self.at, "owner": self.owner, "shape": np.array([self.length, self.bits])}

    def slot(self, words: np.ndarray) -> np.ndarray:
        h = words[..., 0]
        if self.block == 2:
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[..., 1]
        return (K.mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (exclusive) of possible occurrences in one document each, with the hash of their words."""
        n, m = len(hashes), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        lanes = np.arange(m - 1, n, _LANE)
        stop = np.minimum(lanes + _LANE, n)
        at, found = lanes.copy(), []
        while len(at):
            words = np.stack([hashes[at - 1], hashes[at]], axis=-1) if self.block == 2 else hashes[at][:, None]
            jump = self.shift[self.slot(words)].astype(np.int64)
            hit = at[jump == 0]
            if len(hit):
                found.append(hit)
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.concatenate(found)
        last = last[doc[last] == doc[last - m + 1]]
        if m == 1:
            whole = K.mix(hashes[last])
        else:
            whole = hashes[last - m + 1].copy()
            with np.errstate(over="ignore"):
                for k in range(1, m):
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + hashes[last - m + 1 + k]
            whole = K.mix(whole)
        return last + 1, whole

    def occurrences(self, text: K.Words, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, end word, item) of the occurrences whose words are the pattern's."""
        ends, whole = self.search(hashes, doc)
        if not len(ends):
            return
        low, high = (np.searchsorted(self.bucket, whole, side=s) for s in ("left", "right"))
        for k in np.flatnonzero(low < high):
            first, end = int(ends[k]) - self.length, int(ends[k])
            said = b" ".join(text.data[text.start[w] : text.end[w]].tobytes() for w in range(first, end))
            for p in range(low[k], high[k]):
                if self.part.said(int(self.at[p]), self.length) == said:
                    yield first, end, int(self.owner[p])


class Part:
    """A part of the benchmark: its words, joined by spaces, its items' names, and a matcher for each length of pattern."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: list[str]):
        self.data, self.start, self.end, self.names = data, start, end, names
        self.matchers: list[Matcher] = []

    def said(self, word: int, n: int) -> bytes:
        return self.data[self.start[word] : self.end[word + n - 1]].tobytes()

    @classmethod
    def build(cls, names: list[str], texts: pa.Array, window: int) -> Part:
        """``names`` ascend; rows of one name are one item."""
        data, at = K.strings(texts)
        words = K.words(data, at, K.ALNUM, True)
        size = words.end - words.start
        start = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(start, size) + within] = words.data[np.repeat(words.start, size) + within]
        distinct = sorted(set(names))
        number = {name: k for k, name in enumerate(distinct)}
        self = cls(joined, start.astype(np.int32), (start + size).astype(np.int32), distinct)
        hashes, counts = words.hashes(), np.diff(words.first)
        owner = np.array([number[name] for name in names], dtype=np.int64)
        lengths = np.minimum(counts, window)
        for length in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == length)
            many = counts[rows] - length + 1  # more than one where the item is no shorter than a window
            places = np.repeat(words.first[rows], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            self.matchers.append(Matcher.build(hashes, places, np.repeat(owner[rows], many), int(length), self))
        return self

    def packed(self) -> bytes:
        out = io.BytesIO()
        names = pa.array(self.names, pa.large_string())
        text, offsets = K.strings(names)
        own = {"data": self.data, "start": self.start, "end": self.end, "names": text[: offsets[-1]], "offsets": offsets}
        np.savez(out, **own, **{f"{k}.{m}": x for m, table in enumerate(self.matchers) for k, x in table.arrays().items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Part:
        with np.load(io.BytesIO(data)) as held:
            arrays = {k: held[k] for k in held.files}
        text, at = arrays["names"].tobytes(), arrays["offsets"].tolist()
        self = cls(arrays["data"], arrays["start"], arrays["end"], [text[a:b].decode() for a, b in zip(at, at[1:])])
        count = sum(k.startswith("shape.") for k in arrays)
        self.matchers = [Matcher({k: arrays[f"{k}.{m}"] for k in ("shift", "bucket", "at", "owner", "shape")}, self) for m in range(count)]
        return self


_READ: dict[str, Part] = {}


def part_at(path: str) -> Part:
    """Read once in each worker process, which keeps the part that it read last."""
    if path not in _READ:
        fs, name = opened(path)
        _READ.clear()
        with fs.open_input_stream(name) as file:
            _READ[path] = Part.unpacked(file.read())
    return _READ[path]


def pattern_tables(benchmark: DataFrame, window: int, most: int) -> list[str]:
    """Paths of the benchmark's tables, in parts of about ``most`` bytes by hash of the item; one part at least.

    Tasks count the words, and tasks build the parts.  An item is not cut.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))

    def measured(batches):
        for batch in batches:
            data, at = K.strings(batch.column(0))
            size = [int(np.diff(at[i : j + 1]).sum()) + _WORD_BYTES * len(K.words(data, at[i : j + 1], K.ALNUM, False).start) for i, j in K.slices(at)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(size)], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["size", "n"])

    total = rows.select("t").mapInArrow(measured, "size long, n long").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    parts = max(1, min(total.n or 0, math.ceil((total.size or 0) / most)))
    folder = shared_path(benchmark.sparkSession, "patterns")

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("i", "ascending")])
        numbers = table.column("part").to_numpy()
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        for part in np.unique(numbers).tolist():
            mine = table.slice(int(np.searchsorted(numbers, part)), int((numbers == part).sum())).combine_chunks()
            path = f"{folder}/part-{part:05d}"
            own, name = f"{top}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}", f"{top}/part-{part:05d}"
            with fs.open_output_stream(own) as file:
                file.write(Part.build(mine.column("i").to_pylist(), mine.column("t").chunk(0), window).packed())
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    spread = rows.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts))).repartition(parts, "part").select("part", "i", "t")
    paths = sorted(r.path for r in stored(spread.mapInArrow(build, "path string"), "pattern-parts").collect())
    return paths or [_no_patterns(folder)]


def _no_patterns(folder: str) -> str:
    """The path of the tables of an empty benchmark."""
    fs, top = opened(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/part-none") as file:
        file.write(Part.build([], pa.array([], pa.string()), 1).packed())
    return f"{folder}/part-none"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_TABLE_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in each document.

    Returns a row per document row: ``doc_id, n_words, hits`` (word ranges, end
    exclusive, merged and ascending) and ``items`` (ids as strings, sorted).
    A null text has no words; a null item id counts as the empty string; items
    without words match nothing; with an empty benchmark nothing is hit.  Other
    columns of either table are ignored.  The size of the benchmark does not show in
    the result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    first, *others = pattern_tables(benchmark, window, most_bytes)
    if not others:
        return rows.mapInArrow(_scanner(first), SCHEMA)
    keyed = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "*"), "documents")
    found = None
    for path in (first, *others):
        one = keyed.mapInArrow(_scanner(path), "_row long, " + SCHEMA)
        found = one if found is None else found.unionByName(one)
    spans = F.array_sort(F.flatten(F.collect_list("hits")))
    found = found.groupBy("_row", "doc_id", "n_words").agg(_union(spans).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("_row")


def _scanner(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches):
        for batch in batches:
            yield from _scan(batch, part_at(path))

    return scan


def _union(spans):
    """Ascending spans, merged where they touch or overlap."""
    grow = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))
        ),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<first: int, last: int>>"), grow)


def _found(column: pa.Array, part: Part) -> Iterator[tuple[int, int, np.ndarray, list[list[tuple[int, int]]], list[set[int]]]]:
    """(first, end, words of each document, its hits, numbers of its items) for consecutive documents."""
    data, at = K.strings(column)
    for i, j in K.slices(at):
        text = K.words(data, at[i : j + 1], K.ALNUM, True)
        hashes = text.hashes()
        doc = np.repeat(np.arange(j - i), np.diff(text.first))
        hits: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        items: list[set[int]] = [set() for _ in range(j - i)]
        for table in part.matchers:
            for first, end, item in table.occurrences(text, hashes, doc):
                d = int(doc[first])
                base = int(text.first[d])
                hits[d].append((first - base, end - base))
                items[d].add(item)
        yield i, j, np.diff(text.first), hits, items


def _scan(batch: pa.RecordBatch, part: Part) -> Iterator[pa.RecordBatch]:
    """The text is the last column; those before it are passed on."""
    *keys, text = batch.columns
    for i, j, n_words, hits, items in _found(text, part):
        yield pa.RecordBatch.from_arrays(
            [
                *(c.slice(i, j - i) for c in keys),
                pa.array(n_words, type=pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in merged(h)] for h in hits], type=pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                pa.array([sorted(part.names[x] for x in s) for s in items], type=pa.list_(pa.string())),
            ],
            names=[*batch.schema.names[:-1], "n_words", "hits", "items"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: words, words hit, items found and their digest."""

    spans = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    found = find_benchmark(docs, benchmark, window).withColumn("n_hit", spans)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_TABLE_BYTES) -> DataFrame:
    """The documents, all columns, that hold no window of any item.

    Each row is decided by its own text, where it lies, so ids may be null or
    repeat.  There is a pass for each part of the benchmark, over what the parts
    before it left.
    """
    small_batches(docs.sparkSession)
    names, clean = docs.columns, docs
    for k, path in enumerate(pattern_tables(benchmark, window, most_bytes)):

        def keep(batches, path=path):
            for batch in batches:
                free = [not h for _, _, _, hits, _ in _found(batch.column(names.index("text")), part_at(path)) for h in hits]
                yield batch.filter(pa.array(free, pa.bool_()))

        # between parts the rows are written, so that no task holds the tables of several
        clean = (stored(clean, "clean") if k else clean).mapInArrow(keep, docs.schema)
    return clean
