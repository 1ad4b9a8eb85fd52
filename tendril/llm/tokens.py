"""Token ids as Arrow files of equal-length sequences with random access.

Documents are dealt by ranges of ``doc_id`` or of a given order; each task tokenizes its range in
order and writes two Arrow IPC files to the shared folder: the sequences (a
fixed-size list of ids and a fixed-size list of mask bits per row, a batch every
``BATCH_ROWS`` rows, uncompressed, so a memory-mapped reader reaches any sequence
without copying) and the index of the documents (id, first token in the file,
tokens).  The last sequence of a file is padded, and its mask says so.  A file is
written under a name of its attempt and then renamed, so a task that runs twice
leaves one whole file.

Byte-level BPE first splits a text by a pattern that looks ahead one character at
most.  Before a space between two visible characters, between an ASCII letter and
another ASCII character, and after a lone line end before a letter there is always
such a split, so a text's ids are those of its pieces cut there.
Each task keeps the ids of the pieces that it has met (``CACHE_PIECES`` at most; found by a
hash, then compared byte for byte) and calls the tokenizer for new ones only.  Whether the tokenizer is of that kind
is read from its file; another one encodes whole texts.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.shared import opened, qualified, shared_path, small_batches, stored

LENGTH = 2048
BATCH_ROWS = 64
#: Bytes of text that go into a file, about; there are more files than tasks of a shuffle where the texts ask for it.
FILE_BYTES = 256 << 20
#: Distinct pieces whose ids a task remembers; it starts afresh when they are more.
CACHE_PIECES = 1_000_000
_SPACE = 0x20
_CUT_NEXT = np.ones(256, dtype=bool)  # bytes that surely start a character other than white space
_CUT_NEXT[0:0x21] = False
_CUT_NEXT[0x7F:0xC3] = False
_CUT_NEXT[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, dtype=bool)  # ASCII letters
_LETTER[65:91] = _LETTER[97:123] = True
_VISIBLE = np.zeros(256, dtype=bool)  # ASCII without controls and space
_VISIBLE[0x21:0x7F] = True


def splits(path: str) -> bool:
    """Whether the tokenizer's file says byte-level BPE as the cuts above need it: its own pattern, texts as they are, no word marks."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        and said.get("normalizer") is None and not any(said.get(k) for k in ("truncation", "padding"))
    )


class Encoder:
    """Ids of the texts of an Arrow column, slice by slice."""

    def __init__(self, path: str, end_id: int, split: bool | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        self.end_id, self.split = end_id, splits(path) if split is None else split
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)  # byte-level tokens are written with a character for each byte
        self.strings = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # ascending hashes of pieces
        self.place = np.zeros(0, dtype=np.int64)  # of their ids in self.ids
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)
        self.spelled = np.zeros(0, dtype=np.uint8)  # the pieces' own bytes, side by side
        self.at = np.zeros(0, dtype=np.int64)  # where they begin there
        self.size = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, tokens of each document) for consecutive documents; each ends with the end id."""
        data, at = K.strings(column)
        for i, j in K.slices(at):
            cut = self._pieces(data[at[i] : at[j]], at[i : j + 1] - at[i]) if self.split and not self._special(data[at[i] : at[j]]) else None
            if cut is not None:
                yield i, j, *cut
            else:
                many = self.encode([data[a:b].tobytes().decode() for a, b in zip(at[i:j], at[i + 1 : j + 1])])
                counts = np.array([len(x) + 1 for x in many], dtype=np.int64)
                ids = np.fromiter((t for x in many for t in (*x, self.end_id)), dtype=self.dtype, count=int(counts.sum()))
                yield i, j, ids, counts

    def _special(self, data: np.ndarray) -> bool:
        """Whether a string of the tokenizer's own is written out in the texts; those are never cut."""
        raw = data.tobytes()
        return any(s in raw for s in self.strings)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        n = len(at) - 1
        starts = np.zeros(0, dtype=np.int64)
        if len(data):
            cut = np.zeros(len(data), dtype=bool)
            cut[1:-1] = (data[1:-1] == _SPACE) & _CUT_NEXT[data[2:]] & (data[:-2] != _SPACE)
            letter = _LETTER[data]
            cut[1:] |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
            cut[2:] |= letter[2:] & (data[1:-1] == 0x0A) & _VISIBLE[data[:-2]]
            full = at[:-1][np.diff(at) > 0]
            cut[full] = True
            starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = K.mix(K.span_hash(data, starts, ends) + (ends - starts).astype(np.uint64))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != distinct[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_PIECES:
                self.forget()
                new[:] = True
            self._learn(distinct[new], [data[starts[k] : ends[k]].tobytes() for k in first[new]])
            slot = np.searchsorted(self.known, distinct)
        place, count = self.place[slot][inverse], self.count[slot][inverse]
        if not self._spells(slot[inverse], data):
            return None
        first_piece = np.searchsorted(starts, at)
        upto = np.concatenate([[0], np.cumsum(count)])
        tokens = upto[first_piece[1:]] - upto[first_piece[:-1]] + 1
        ids = np.full(int(tokens.sum()), self.end_id, dtype=self.dtype)
        doc = np.repeat(np.arange(n), np.diff(first_piece))  # each earlier document has put in one end id
        total = int(upto[-1])
        within = np.arange(total) - np.repeat(upto[:-1], count)
        ids[np.arange(total) + np.repeat(doc, count)] = self.ids[np.repeat(place, count) + within]
        return ids, tokens

    def _spells(self, slots: np.ndarray, data: np.ndarray) -> bool:
        """Whether the cached pieces are those of the texts, byte for byte: two pieces may have one hash."""
        size = self.size[slots]
        upto = np.cumsum(size)
        if int(upto[-1] if len(upto) else 0) != len(data):
            return False
        return bool((self.spelled[np.repeat(self.at[slots] - (upto - size), size) + np.arange(len(data))] == data).all())

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """``hashes`` ascend.  Pieces are encoded side by side where that is safe, and told apart by their ids' bytes."""
        kind = np.array([1 if p[0] == _SPACE else 2 if _LETTER[p[0]] and _VISIBLE[p[-1]] else 0 for p in pieces])
        count, place = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        got = [self.ids]
        base = len(self.ids)
        for k, lead in ((1, b""), (2, b"\n")):  # words without a space get a line end before them, whose id goes
            side = [lead + p for p, x in zip(pieces, kind) if x == k]
            ids = np.concatenate(
                [np.zeros(0, dtype=np.int64), *(np.array(x, dtype=np.int64) for x in self.encode([b"".join(side[n : n + 2000]).decode() for n in range(0, len(side), 2000)]))]
            )
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in side]) if side else [], side="left") + 1
            count[kind == k] = np.diff(upto, prepend=0) - len(lead)
            place[kind == k] = base + upto - count[kind == k]
            got.append(ids.astype(self.dtype))
            base += len(ids)
        alone = self.encode([p.decode() for p, x in zip(pieces, kind) if x == 0])
        count[kind == 0] = [len(x) for x in alone]
        place[kind == 0] = base + np.cumsum(count[kind == 0]) - count[kind == 0]
        self.ids = np.concatenate([*got, np.fromiter((t for x in alone for t in x), dtype=self.dtype)])
        own = np.array([len(p) for p in pieces], dtype=np.int64)
        begin = len(self.spelled) + np.cumsum(own) - own
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(pieces), dtype=np.uint8)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.place, self.count = np.insert(self.known, at, hashes), np.insert(self.place, at, place), np.insert(self.count, at, count)
        self.at, self.size = np.insert(self.at, at, begin), np.insert(self.size, at, own)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_for(path: str, end_id: int, split: bool | None) -> Encoder:
    """One encoder for each worker process: the pieces it knows serve its later tasks too."""
    key = (path, end_id, split)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, end_id, split)
    return _ENCODERS[key]


class SequenceWriter:
    """Packs a stream of ids into rows of ``length`` ids and mask bits."""

    def __init__(self, sink, dtype, length: int):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest = np.zeros(0, dtype=dtype)

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids])
        step = self.length * BATCH_ROWS
        whole = len(ids) // step * step
        for k in range(0, whole, step):
            self._write(ids[k : k + step], step)
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if real := len(self.rest):
            pad = -real % self.length
            self._write(np.concatenate([self.rest, np.zeros(pad, dtype=self.dtype)]), real)
        self.out.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_sequences(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, length: int = LENGTH, split: bool | None = None, files: int
    | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Writes the ids of all ``docs`` in ascending ``doc_id`` order, or by the columns of ``order``; returns a row per file.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can
    read; ``split`` overrides what its file says of cutting texts.  A null text is empty and has the end id alone; null ids come first;
    rows of equal id are written in the order of their texts (equal places of ``order`` in any).  The rows returned
    are ``part, path, n_docs, n_tokens`` by ``part``; they come from a written
    table, so the files are written once.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_path(spark, "sequences")
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if order is None:
        keys = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
        dealt = docs.select(*columns).repartitionByRange(files, keys[0]).sortWithinPartitions(*keys)
    else:
        keys = [f"_order{k}" for k in range(len(order))]
        placed = docs.select(*columns, *(c.alias(k) for c, k in zip(order, keys)))
        dealt = placed.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        part = task.partitionId()
        name, own = f"{top}/part-{part:06d}", f"{top}/.part-{part:06d}-{task.taskAttemptId()}"
        encoder = encoder_for(tokenizer, end_id, split)
        n_docs = n_tokens = 0
        with fs.open_output_stream(own + ".ids") as ids_out, fs.open_output_stream(own + ".docs") as docs_out:
            rows, index = SequenceWriter(ids_out, encoder.dtype, length), pa.ipc.new_file(docs_out, INDEX)
            for batch in (b for several in ([first], batches) for b in several):
                for i, j, ids, counts in encoder.slices(batch.column(1)):
                    rows.add(ids)
                    starts = n_tokens + np.cumsum(counts) - counts
                    index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(starts), pa.array(counts)], schema=INDEX))
                    n_docs, n_tokens = n_docs + j - i, n_tokens + int(counts.sum())
            rows.close()
            index.close()
        fs.move(own + ".ids", name + ".ids.arrow")
        fs.move(own + ".docs", name + ".docs.arrow")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([folder]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
            names=["part", "path", "n_docs", "n_tokens"]
        )

    return stored(dealt.mapInArrow(write, "part int, path string, n_docs long, n_tokens long"), "sequence-files")


def _reader(fs: pafs.FileSystem, path: str):
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(fs.open_input_file(path))


def read_sequence(path: str, part: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the ``k``-th sequence of a file, without reading the others."""
    fs, top = opened(path)
    file = _reader(fs, f"{top}/part-{part:06d}.ids.arrow")
    batch = file.get_batch(k // BATCH_ROWS)
    row = k % BATCH_ROWS
    length = batch.column(0).type.list_size
    return batch.column(0).values.slice(row * length, length).to_numpy(), batch.column(1).values.slice(row * length, length).to_numpy(zero_copy_only=False)


def read_documents(files: DataFrame) -> DataFrame:
    """A row per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    The driver adds up the files' token counts, one number a file.
    """
    spark = files.sparkSession
    at, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append(Row(part=r.part, path=r.path, base=at))
        at += r.n_tokens

    def read(batches):
        for batch in batches:
            for part, path, base in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _documents(part, path, base)

    listed = spark.createDataFrame(rows, "part int, path string, base long")
    return listed.repartition(max(1, len(rows)), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(part: int, path: str, base: int) -> Iterator[pa.RecordBatch]:
    fs, top = opened(path)
    name = f"{top}/part-{part:06d}"
    ids_file, docs_file = _reader(fs, name + ".ids.arrow"), _reader(fs, name + ".docs.arrow")
    held, held_at, next_batch = np.zeros(0, dtype=np.uint32), 0, 0
    for k in range(docs_file.num_record_batches):
        batch = docs_file.get_batch(k)
        starts, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        sums = []
        for start, count in zip(starts.tolist(), counts.tolist()):
            while held_at + len(held) < start + count:
                more = ids_file.get_batch(next_batch)
                real = more.column(0).values.to_numpy()[more.column(1).values.to_numpy(zero_copy_only=False)]
                held, held_at, next_batch = np.concatenate([held[max(0, start - held_at) :], real.astype("<u4")]), max(held_at, min(start, held_at + len(held))), next_batch + 1
            sums.append(zlib.crc32(held[start - held_at : start - held_at + count].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(starts + base), batch.column(2), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def tokens_written(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, order: list[Column] | None = None) -> DataFrame:
    """Writes the documents' ids and returns what the files hold, a row per document."""
    return read_documents(write_sequences(docs, tokenizer, end_id=end_id, length=length, order=order))
