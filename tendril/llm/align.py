"""Alignment of two tokenizers' tokens, counted over a corpus by minimal perfect hashing.

The first pass encodes each document with both tokenizers, takes token ends as byte
offsets, and links the tokens whose ranges overlap; a task counts the documents that
hold each linked pair of ids, and its sums are written.  Of the distinct pairs a minimal
perfect hash is built in buckets, one a task: bit arrays, level by level, of the pairs
that are alone in their place; what is left goes to the next level, and a pair's number
is the rank of its bit.  The sums of each eight tasks become dense vectors by these
numbers, and vectors are added up in a tree.  A bucket's bits, its pairs by number and
its counts are one file of the shared folder.  The second pass aligns the documents
again and looks the counts up; the pair that lies at the number is compared, always.

Both tokenizers, where their files say that they are of the usual kind, never join what
lies on two sides of a space that follows a visible character.  So texts are cut there,
and a piece's alignment is that of its text alone: tasks keep the pieces they have met.
Other tokenizers get whole texts.
"""

from __future__ import annotations

import hashlib
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.shared import Scratch, opened, qualified, shared_path, small_batches
from tendril.llm.tokens import splits

U64 = np.uint64
#: Pairs of a bucket of the hash, about, and bytes of buckets that a task holds; it reads others again when it needs them.
BUCKET_PAIRS, HELD_BYTES = 1 << 15, 256 << 20
#: Tasks whose sums make one dense vector, and vectors that are added up at a time.
FAN = 8
#: Pieces, and links of pieces, that a task remembers; it starts afresh when they are more.
CACHE_PIECES, CACHE_LINKS = 800_000, 8_000_000
SLICE_BYTES, JOINED_BYTES = 4 << 20, 8 << 10
#: Pair sums that a task holds before it adds equal ones up, and before it hands them on.
HELD_PAIRS, MOST_PAIRS = 1 << 20, 4 << 20
#: The primes of the 64-bit hash, whose numbers for longs are those of the SQL function xxhash64.
_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """``xxhash64`` of longs, as unsigned numbers."""
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    with np.errstate(over="ignore"):
        h = U64(seed) + _P5 + U64(8)
        h = h ^ (turn(values.astype(U64) * _P2, 31) * _P1)
        h = turn(h, 27) * _P1 + _P4
        h ^= h >> U64(33)
        h *= _P2
        h ^= h >> U64(29)
        h *= _P3
        return h ^ (h >> U64(32))


class Perfect:
    """A minimal perfect hash of distinct longs: their ranks in levels of bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = np.unpackbits(bits, count=int(self.first[-1])).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1

    @staticmethod
    def of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level sizes and packed bits for ``keys``."""
        sizes, levels = [], []
        while len(keys):
            size = 2 * len(keys) + 1
            place = (hashed(keys, len(sizes)) % U64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[place]]
        return np.array(sizes, dtype=np.int64), np.packbits(np.concatenate(levels)) if levels else np.zeros(0, dtype=np.uint8)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1, each once, for the n keys that it was built of; anything or -1 for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = self.first[level] + (hashed(keys[left], level) % U64(size)).astype(np.int64)
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


class Counts:
    """Buckets of counts, read from the shared folder as they are needed."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def bucket_of(self, pairs: np.ndarray) -> np.ndarray:
        return hashed(pairs).view(np.int64) % self.buckets

    def bucket(self, k: int) -> tuple[Perfect, np.ndarray, np.ndarray | None]:
        """The hash, the pairs by number and the counts by number, if they are there yet."""
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        sizes, bits, pairs = _load(f"{self.folder}/pairs-{k:06d}")
        counts = _load(f"{self.folder}/counts-{k:06d}")[0] if _there(f"{self.folder}/counts-{k:06d}") else None
        found = Perfect(sizes, bits), pairs, counts
        self.held[k] = found
        self.bytes += 5 * len(found[0].bits) + 16 * len(pairs)
        while self.bytes > HELD_BYTES and len(self.held) > 1:
            _, (perfect, old, _) = self.held.popitem(last=False)
            self.bytes -= 5 * len(perfect.bits) + 16 * len(old)
        return found

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair; a pair that is not the one at its number is an error."""
        distinct, inverse = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        where = self.bucket_of(distinct)
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
            perfect, known, counts = self.bucket(int(where[part[0]]))
            at = perfect.number(distinct[part])
            if not (known[at] == distinct[part]).all():
                raise ValueError("a pair is not in the table that the first pass made")
            out[part] = counts[at]
        return out[inverse]


def _save(path: str, *arrays: np.ndarray) -> None:
    """Arrays as one file, written under the attempt's name and then renamed."""
    fs, name = opened(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    own = f"{os.path.dirname(name)}/.{TaskContext.get().taskAttemptId()}-{os.path.basename(name)}"
    with fs.open_output_stream(own) as out:
        for x in arrays:
            raw = np.ascontiguousarray(x).tobytes()
            out.write(np.array([len(raw)], dtype=np.int64).tobytes() + x.dtype.str.encode().ljust(8) + raw)
    fs.move(own, name)


def _load(path: str) -> list[np.ndarray]:
    fs, name = opened(path)
    with fs.open_input_stream(name) as file:
        raw, at, out = file.read(), 0, []
    while at < len(raw):
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        kind = np.dtype(raw[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at + 16))
        at += 16 + size
    return out


def _there(path: str) -> bool:
    fs, name = opened(path)
    return fs.get_file_info(name).type.name == "File"


class Table:
    """Bytes of each id of a tokenizer, side by side."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.shown = [str(k) for k in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]


def _byte_of() -> dict[str, int]:
    """The byte of each character that byte-level tokens are written with: visible Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
#: First bytes of two-byte and of three-byte characters none of which is white space.
_TWO, _THREE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True
_THREE[0xE0] = True
_THREE[0xE4:0xF0] = True


def _after_visible(data: np.ndarray) -> np.ndarray:
    """Which bytes follow a character that is surely not white space."""
    out = np.zeros(len(data), dtype=bool)
    out[1:] = _VISIBLE[data[:-1]]
    out[2:] |= (data[1:-1] >= 0x80) & _TWO[data[:-2]]
    out[3:] |= (data[2:-1] >= 0x80) & (data[1:-2] >= 0x80) & _THREE[data[:-3]]
    return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1024, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(need, len(self.room)), dtype=self.room.dtype)])
        self.room[self.n : need] = values
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Aligner:
    """Alignments of the texts of an Arrow column, piece by piece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of()
        entries = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            entries[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.table_a = Table(entries)
        self.table_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.cuts = splits(path_a) and not any("▁" in p.lstrip("▁") for p in pieces) and self._plain()
        self.looked_up: Counts | None = None
        self.best = np.zeros(0, dtype=np.int64)
        self.forget()

    def _plain(self) -> bool:
        """Whether the second tokenizer leaves spaces and cases as they are."""
        said = ["a  b", " a", "A b "]
        return all(self.table_b.joined(np.array(ids, dtype=np.int64)).tobytes().decode() == " " + s for s, ids in zip(said, self.b.encode(said, num_threads=1)))

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes = [Grown(np.int64) for _ in range(4)]  # of each piece: tokens of either kind, groups, links
        self.ok, self.place = Grown(bool), Grown(np.int64)
        self.links = Grown(np.int64)
        self.sums, self.bests = Grown(np.int64), Grown(np.int64)  # of counts, of best links; -1 if not looked up
        self.shown: list[str] = []

    def use(self, counts: Counts, best: np.ndarray) -> None:
        if self.looked_up is None or self.looked_up.folder != counts.folder:
            self.looked_up, self.best = counts, best
            self.sums.all[:] = -1

    def _encoded(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of texts that begin with a space; the second tokenizer puts that one itself."""
        whole = [t.decode(errors="replace") for t in texts]
        ids_a = [np.array(e.ids, dtype=np.int64) for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        ids_b = [np.array(x, dtype=np.int64) for x in self.b.encode([t[1:] for t in whole], num_threads=1)]
        return ids_a, ids_b

    def _same(self, ids_a: np.ndarray, ids_b: np.ndarray, text: bytes) -> bool:
        return all(t.joined(ids).tobytes() == text for t, ids in ((self.table_a, ids_a), (self.table_b, ids_b)))

    def _learn(self, pieces: list[bytes], together: np.ndarray) -> None:
        """New pieces; those ``together`` are encoded side by side, as nothing joins them."""
        alone = [k for k in np.flatnonzero(~together)]
        order, ids_a, ids_b, fine = [], [], [], np.ones(len(pieces), dtype=bool)
        rows, held, runs = [], 0, []
        for k in np.flatnonzero(together):
            rows.append(k)
            held += len(pieces[k])
            if held >= JOINED_BYTES:
                runs.append(rows)
                rows, held = [], 0
        if rows:
            runs.append(rows)
        texts = [b"".join(pieces[k] for k in r) for r in runs]
        for run, text, a, b in zip(runs, texts, *self._encoded(texts)):
            if self._same(a, b, text):
                order += run
                ids_a.append(a)
                ids_b.append(b)
            else:
                alone += run
        single = [pieces[k] for k in alone]
        for k, text, a, b in zip(alone, single, *self._encoded(single)):
            fine[k] = self._same(a, b, text)
            order.append(k)
            ids_a.append(a if fine[k] else a[:0])
            ids_b.append(b if fine[k] else b[:0])
        order = np.array(order, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        a, b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        size = np.array([len(pieces[k]) if fine[k] else 0 for k in order], dtype=np.int64)
        ends, end_a, end_b = np.cumsum(size), np.cumsum(self.table_a.size[a]), np.cumsum(self.table_b.size[b])
        groups = np.intersect1d(end_a, end_b, assume_unique=True)
        low = np.searchsorted(end_b, end_a - self.table_a.size[a], side="right")
        many = np.searchsorted(end_b, end_a, side="left") - low + 1
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        links = (np.repeat(a, many) << 32) | b[np.repeat(low, many) + within]
        piece_a, piece_b, piece_g = (np.searchsorted(ends, x, side="left") for x in (end_a, end_b, groups))
        n = len(order)
        found = [np.bincount(x, minlength=n) for x in (piece_a, piece_b, piece_g, np.repeat(piece_a, many))]
        to_a, to_b = np.searchsorted(end_a, groups, side="right").tolist(), np.searchsorted(end_b, groups, side="right").tolist()
        said_a, said_b = [self.table_a.shown[x] for x in a.tolist()], [self.table_b.shown[x] for x in b.tolist()]
        written, i, j = [], 0, 0
        for x, y in zip(to_a, to_b):
            written.append(f"{said_a[i] if x == i + 1 else ','.join(said_a[i:x])}|{said_b[j] if y == j + 1 else ','.join(said_b[j:y])}")
            i, j = x, y
        upto = np.concatenate([[0], np.cumsum(found[2])]).tolist()
        for grown, values in zip(self.sizes, found):
            grown.add(values)
        self.place.add(self.links.n + np.cumsum(found[3]) - found[3])
        self.links.add(links)
        self.ok.add(fine[order])
        for grown in (self.sums, self.bests):
            grown.add(np.full(n, -1))
        base = len(self.shown)
        for k, piece in enumerate(order.tolist()):
            self.known[pieces[piece]] = base + k
            self.shown.append(";".join(written[upto[k] : upto[k + 1]]))

    def _codes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of texts that each begin with a space, and the first piece of each text."""
        follows = _after_visible(data) if self.cuts else np.zeros(len(data), dtype=bool)
        cut = (data == 0x20) & follows
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        offsets = np.append(starts, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > CACHE_PIECES or self.links.n > CACHE_LINKS:
            self.forget()
        number = np.array([self.known.get(w, -1) for w in words], dtype=np.int64)
        index = coded.indices.to_numpy()
        new = np.flatnonzero(number < 0)
        if len(new):
            first = np.empty(len(words), dtype=np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            end = ends[first[new]]
            ends_well = np.full(len(new), self.cuts)
            ends_well[end < len(data)] &= follows[end[end < len(data)]]
            ends_well[end == len(data)] &= bool(len(data)) and bool(_after_visible(np.append(data[-4:], 0x20).astype(np.uint8))[-1])
            learnt = [words[k] for k in new.tolist()]
            self._learn(learnt, ends_well)
            number[new] = [self.known[w] for w in learnt]
        return number[index], np.searchsorted(starts, at)

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, piece numbers, first piece of each document and the end) for consecutive documents.

        A document has no pieces if it is null or empty, or if its tokens do not spell it.
        """
        data, at = K.strings(column)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
            here, size = data[at[i] : at[j]], np.diff(at[i : j + 1])
            spaced = np.insert(here, (at[i:j] - at[i])[size > 0], 0x20)
            bounds = np.concatenate([[0], np.cumsum(size + (size > 0))])
            codes, first = self._codes(spaced, bounds)
            wrong = ~self.ok.all[codes]
            if wrong.any():
                codes, first = self._settled(spaced, bounds, codes, first, wrong)
            yield i, j, codes, first
            i = j

    def _settled(self, data, bounds, codes, first, wrong) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a piece whose tokens do not spell it are encoded whole: they have those tokens or none."""
        parts = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
        for k in np.unique(np.searchsorted(first, np.flatnonzero(wrong), side="right") - 1).tolist():
            text = data[bounds[k] : bounds[k + 1]].tobytes()
            if text not in self.known:
                self._learn([text], np.zeros(1, dtype=bool))
            number = self.known[text]
            parts[k] = np.array([number] if self.ok.all[number] else [], dtype=np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def links_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of pieces, and how many each has."""
        many = self.sizes[3].all[codes]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return self.links.all[np.repeat(self.place.all[codes], many) + within], many

    def count(self, codes: np.ndarray) -> None:
        """Looks up the links of the pieces that have not been looked up."""
        missing = np.unique(codes)
        missing = missing[self.sums.all[missing] < 0]
        if not len(missing):
            return
        links, many = self.links_of(missing)
        found = self.looked_up.look_up(links)
        piece = np.repeat(np.arange(len(missing)), many)
        self.sums.all[missing] = np.bincount(piece, found, len(missing)).astype(np.int64) if found.sum() < 1 << 52 else _added(piece, found, len(missing))
        self.bests.all[missing] = np.bincount(piece, found == self.best[links >> 32], len(missing)).astype(np.int64)


def _added(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, where, values)
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_for(path_a: str, path_b: str) -> Aligner:
    """One for each worker process: the pieces that it knows serve its later tasks too."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, _added(inverse, np.concatenate(counts), len(distinct))


def pair_sums(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``part, pair, docs``: of each task, the linked pairs (the first id times 2^32 plus the second) and how many of its documents hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(path_a, path_b)
        part = TaskContext.get().partitionId()
        pairs, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[0]), part), pa.int64()), pa.array(pairs[0]), pa.array(counts[0])], names=["part", "pair", "docs"])

        for batch in batches:
            for i, j, codes, first in aligner.slices(batch.column(0)):
                if not len(codes):
                    continue
                distinct, local = np.unique(codes, return_inverse=True)
                links, many = aligner.links_of(distinct)
                known, number = np.unique(links, return_inverse=True)
                each = np.unique(np.repeat(np.arange(j - i), np.diff(first)) * len(distinct) + local)  # a document's pieces, each once
                piece = each % len(distinct)
                size = many[piece]
                at = np.repeat((np.cumsum(many) - many)[piece] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                once = np.unique(np.repeat(each // len(distinct), size) * len(known) + number[at])
                pairs.append(known)
                counts.append(np.bincount(once % len(known), minlength=len(known)))
                held += len(known)
                if held > HELD_PAIRS:
                    pairs, counts = ([x] for x in _summed(pairs, counts))
                    held = len(pairs[0]) // 2
                    if len(pairs[0]) > MOST_PAIRS:
                        yield out()
                        pairs, counts, held = [], [], 0
        if pairs:
            pairs, counts = ([x] for x in _summed(pairs, counts))
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part long, pair long, docs long")


def _built(folder: str):
    def build(key, table):
        """One bucket's hash and its pairs by number, as a file."""
        k, pairs = key[0].as_py(), table.column("pair").to_numpy()
        sizes, bits = Perfect.of(pairs)
        placed = np.empty_like(pairs)
        placed[Perfect(sizes, bits).number(pairs)] = pairs
        _save(f"{folder}/pairs-{k:06d}", sizes, bits, placed)
        return pa.table({"bucket": pa.array([k], pa.int64()), "n": pa.array([len(pairs)], pa.int64())})

    return build


def _dense(folder: str, buckets: int):
    def dense(key, table):
        """The counts of a bucket's pairs in a few tasks, as one vector by number."""
        perfect, pairs, _ = Counts(folder, buckets).bucket(key[1].as_py())
        vector = _added(perfect.number(table.column("pair").to_numpy()), table.column("docs").to_numpy(), len(pairs))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "bucket": pa.array([key[1].as_py()], pa.int64()), "vector": pa.array([vector.tobytes()], pa.binary())})

    return dense


def _added_up(key, table):
    vector = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("vector").to_pylist())
    return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "bucket": pa.array([key[1].as_py()], pa.int64()), "vector": pa.array([vector.tobytes()], pa.binary())})


def _finished(folder: str, buckets: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a bucket's counts; returns each first id's highest."""
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, dtype=np.int64)
                _save(f"{folder}/counts-{k:06d}", counts)
                ids = Counts(folder, buckets).bucket(k)[1] >> 32
                order = np.lexsort((counts, ids))
                last = np.append(np.flatnonzero(np.diff(ids[order])), len(order) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[order][last]), pa.array(counts[order][last])], names=["a", "most"])

    return finish


def pair_counts(docs: DataFrame, path_a: str, path_b: str, folder: str, bucket_pairs: int = BUCKET_PAIRS) -> tuple[int, np.ndarray]:
    """Counts of linked pairs as files in ``folder``; the number of buckets and each first id's highest count.

    The highest counts are one number an id of the first vocabulary, so their size is known.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sums = scratch.stored(pair_sums(docs, path_a, path_b), "pair-sums")
    distinct = scratch.stored(sums.select("pair").distinct(), "pairs")
    buckets = max(1, -(-distinct.count() // bucket_pairs))
    bucket = F.pmod(F.xxhash64("pair"), F.lit(buckets)).cast("long")
    scratch.stored(distinct.groupBy(bucket.alias("bucket")).applyInArrow(_built(folder), "bucket long, n long"), "buckets")
    shape = "leaf long, bucket long, vector binary"
    vectors = sums.groupBy(F.expr(f"part div {FAN}").alias("leaf"), bucket.alias("bucket")).applyInArrow(_dense(folder, buckets), shape)
    leaves = (sums.agg(F.max("part")).first()[0] or 0) // FAN + 1
    while leaves > 1:
        leaves = -(-leaves // FAN)
        vectors = vectors.withColumn("leaf", F.expr(f"leaf div {FAN}")).groupBy("leaf", "bucket").applyInArrow(_added_up, shape)
    most = scratch.stored(vectors.select("bucket", "vector").mapInArrow(_finished(folder, buckets), "a long, most long"), "most")
    best = np.zeros(0, dtype=np.int64)
    rows = most.groupBy("a").agg(F.max("most").alias("most")).toArrow()
    if rows.num_rows:
        ids = rows.column("a").to_numpy()
        best = np.zeros(int(ids.max()) + 1, dtype=np.int64)
        best[ids] = rows.column("most").to_numpy()
    scratch.clear()
    return buckets, best


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def aligned(docs: DataFrame, path_a: str, path_b: str, folder: str | None = None, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``path_a`` names a byte-level ``tokenizers`` file, which encodes a space and the
    text, ``path_b`` a ``sentencepiece`` model that puts the space itself; strings of
    special tokens are plain text.  Byte offsets where tokens of both end cut them into
    groups, written ``a1,a2|b1;a3|b2,b3``; links are the pairs of tokens that overlap,
    their counts the documents that hold the pair of ids linked, ``n_best`` the links
    whose count is the highest of their first id.  Null and empty texts, and those that
    either kind of tokens does not spell, have zeros and an empty string.  Rows are
    documents, whatever their ids; only ``doc_id`` and ``text`` are read.
    """
    return _second_pass(docs, path_a, path_b, folder, bucket_pairs, None)


def aligned_digests(docs: DataFrame, path_a: str, path_b: str, folder: str | None = None) -> DataFrame:
    """As ``aligned``, with ``groups_sha256`` (empty for documents without tokens) in place of the groups."""
    digest = lambda said: hashlib.sha256(said.encode()).hexdigest() if said else ""
    return _second_pass(docs, path_a, path_b, folder, BUCKET_PAIRS, digest).withColumnRenamed("groups", "groups_sha256")


def _second_pass(docs: DataFrame, path_a: str, path_b: str, folder: str | None, bucket_pairs: int, shown_as) -> DataFrame:
    small_batches(docs.sparkSession)
    folder = qualified(docs.sparkSession, folder) if folder else shared_path(docs.sparkSession, "alignment")
    buckets, best = pair_counts(docs, path_a, path_b, folder, bucket_pairs)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(path_a, path_b)
        aligner.use(Counts(folder, buckets), best)
        for batch in batches:
            for i, j, codes, first in aligner.slices(batch.column(1)):
                aligner.count(codes)
                sums = [np.concatenate([[0], np.cumsum(x.all[codes])]) for x in (*aligner.sizes, aligner.bests, aligner.sums)]
                shown = list(map(aligner.shown.__getitem__, codes.tolist()))
                said = [";".join(shown[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                columns = [
                    batch.column(0).slice(i, j - i), *(pa.array(s[first[1:]] - s[first[:-1]]) for s in sums),
                    pa.array([shown_as(x) for x in said] if shown_as else said, pa.string())
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ALIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look_up, ALIGNED)
