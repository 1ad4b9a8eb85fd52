"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference is the corpus itself: an index, whose blocks lie where the windows'
hashes send them, maps each window of ``window`` words to its first place.  A parse
walks over a document and takes, at the next word at which a window is known from an
earlier place, a factor from that place: it goes on, word by word in both texts, as
long as the next window's place is the next one there.  Where it is another place
the next factor begins, and windows across the boundary of two factors are known
from places of their own.  Factors are thus at least ``window`` words long, and the
words that they cover are the duplicate spans.

Windows meet by 95 bits of two hashes, and then words are compared.  Factors whose
place lies in the same batch are compared there, word by word.  Of the others each
distinct span is asked for once, of the document that it lies in: the texts of one
shuffle serve the look-ups, the parse and what is asked of them, and both sides send
16 bytes that stand for the span's words.  If any two differ, windows of different
words had equal hashes, and the parse is done again with other hashes.

The index need not see windows that occur once.  Each document names some places
that depend on nearby words alone: an anchor is a run of ``ANCHOR`` words whose
hash is least among the runs of a window, so equal windows name equal anchors.  A
first, thin shuffle finds the anchors that occur more than once; only windows with
such an anchor are looked up.  Tasks settle what repeats within a batch before
they send anything, so a passage that a third of all documents hold is sent once
a batch and not once a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.shared import stored

WINDOW = 20
ANCHOR = 8
#: Hash bits by which windows meet, for each parse: the next one is done if words and hashes disagree.
BITS = (95, 95, 95)

FOUND = "key long, doc_id long, start int, starts binary"
SENT = "key long, more int, doc_id long, start int, runs binary"
#: Consecutive windows of a document that occur from ``ref_start`` on in ``ref_doc``.
RUN = np.dtype([("start", "<i4"), ("windows", "<i4"), ("ref_doc", "<i8"), ("ref_start", "<i4")])
FACTORS = "array<struct<first: int, last: int, ref_doc: long, ref_start: int, digest: binary>>"
ASKED = "array<struct<start: int, words: int, digest: binary>>"


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the hash of its run of ``size`` words, whether a window starts there, and the place of that window's anchor."""
    n = len(hashes)
    run = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    if n >= size:
        run[: n - size + 1] = K.grams(hashes, size)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words left in the document
    starts = room >= window
    reach = window - size + 1
    best, at = run.copy(), np.arange(n)
    span = 1
    while span < reach:  # minima over spans of 1, 2, 4 ... and then the rest; the leftmost wins ties
        step = min(span, reach - span)
        other, other_at = np.append(best[step:], np.full(step, run.dtype.type(np.iinfo(np.uint64).max))), np.append(at[step:], np.zeros(step, dtype=at.dtype))
        lower = other < best
        best, at = np.where(lower, other, best), np.where(lower, other_at, at)
        span += step
    return run, starts, at


def _pre_settled(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries to send, the first of each key, and which are known to occur twice here.

    Entries come in the order of document and place.
    """
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    send, settled = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    send[order[~same]] = True
    settled[order[same | np.append(same[1:], False)]] = True
    return send, settled


def _emit(ids: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, send: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, start) to compare elsewhere, and for each document the places that are settled, in bytes."""
    k = np.flatnonzero(send)
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[k].view(np.int64)), pa.array(ids[doc[k]]), pa.array(place[k].astype(np.int32)), pa.nulls(len(k), pa.binary())],
        names=["key", "doc_id", "start", "starts"]
    )
    s = np.flatnonzero(settled)
    if len(s):
        cut = np.flatnonzero(np.diff(doc[s])) + 1
        which = doc[s[np.append(0, cut)]]
        packed = [x.astype("<i4").tobytes() for x in np.split(place[s], cut)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(K.mix(ids[which].astype(np.uint64)).view(np.int64)), pa.array(ids[which]), pa.nulls(len(which), pa.int32()), pa.array(packed, pa.binary())],
            names=["key", "doc_id", "start", "starts"]
        )


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """By id: within a batch the earlier place is the earlier row."""
    return batch.take(pa.array(np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")))


def _anchor_rows(window: int, size: int) -> Callable:
    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = K.strings(batch.column(1))
            keys, docs, places, flags = [], [], [], []
            for i, j in K.slices(at):
                text = K.words(data, at[i : j + 1], K.SPACED, False)
                run, starts, anchor = anchors(text.hashes(), text.first, window, size)
                chosen = np.unique(anchor[starts])
                doc = np.searchsorted(text.first, chosen, side="right") - 1
                keys.append(run[chosen])
                docs.append(doc + i)
                places.append(chosen - text.first[doc])
            if keys:
                key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
                yield from _emit(ids, key, doc, place, *_pre_settled(key))

    return rows


def _repeated(found: DataFrame) -> DataFrame:
    """The places of anchors that occur elsewhere too: ``doc_id, start, starts``.

    Rows come sorted by key; a key's rows are followed as they stream by, none are
    kept but the last.
    """

    def rows(batches):
        held = None  # the last row of the batch before, if its fate is open
        last_key, last_repeats = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            packed = ~np.array(batch.column(3).is_null())
            # packed rows have keys of their own kind: they never count as a neighbour
            at = np.flatnonzero(~packed)
            same = np.zeros(len(at), dtype=bool)
            if len(at):
                same[1:] = key[at[1:]] == key[at[:-1]]
                same[0] = last_repeats if held is not None else last_key is not None and key[at[0]] == last_key
            keep = packed.copy()
            keep[at[same]] = True
            held = None
            if len(at):
                keep[at[:-1][same[1:]]] = True
                if not keep[at[-1]]:  # the next batch may begin with its like
                    held = batch.slice(int(at[-1]), 1)
                last_key, last_repeats = int(key[at[-1]]), bool(same[-1])
            out = batch.filter(pa.array(keep))
            if out.num_rows:
                yield out.select(["doc_id", "start", "starts"])

    order = ["key", "doc_id", "start"]
    return found.repartition("key").sortWithinPartitions(*order).mapInArrow(rows, "doc_id long, start int, starts binary")


def _referred(sent: DataFrame) -> DataFrame:
    """Each window that has an earlier place, with the first: ``doc_id, start, ref_doc, ref_start, runs``.

    Rows come sorted by hash, document and place, so a window's first place streams by
    before the others; only that is kept.
    """

    def rows(batches):
        last = head = None  # the hash of the row before, and its window's first place
        for batch in batches:
            packed = np.array(batch.column(4).is_valid())
            plain = batch.filter(pa.array(~packed))
            n = plain.num_rows
            if packed.any():
                runs = batch.filter(pa.array(packed))
                none = pa.nulls(runs.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [runs.column(2), none, pa.nulls(runs.num_rows, pa.int64()), none, runs.column(4)],
                    names=["doc_id", "start", "ref_doc", "ref_start", "runs"]
                )
            if not n:
                continue
            key, more, doc, start = (plain.column(k).to_numpy() for k in range(4))
            new = np.ones(n, dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
            new[0] = last != (int(key[0]), int(more[0]))
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            ref_doc, ref_start = doc[at], start[at]
            if not new[0]:
                ref_doc[at < 0], ref_start[at < 0] = head
            last, head = (int(key[-1]), int(more[-1])), (int(ref_doc[-1]), int(ref_start[-1]))
            k = np.flatnonzero(~new)
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[k]), pa.array(start[k]), pa.array(ref_doc[k]), pa.array(ref_start[k]), pa.nulls(len(k), pa.binary())],
                    names=["doc_id", "start", "ref_doc", "ref_start", "runs"]
                )

    order = ["key", "more", "doc_id", "start"]
    return sent.repartition("key").sortWithinPartitions(*order).mapInArrow(rows, "doc_id long, start int, ref_doc long, ref_start int, runs binary")


def _by_document(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id").agg(F.collect_list("start").alias("some"), F.collect_list("starts").alias("packed"))


def _unpack(some: pa.Array, packed: pa.Array, k: int) -> np.ndarray:
    parts = [np.array(some[k].as_py() or [], dtype=np.int64)]
    parts += [np.frombuffer(b, dtype="<i4").astype(np.int64) for b in packed[k].as_py() or []]
    return np.unique(np.concatenate(parts))


def _runs(doc: np.ndarray, start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of ``doc, start`` as runs that go on by one word in both texts, and each run's ``doc``."""
    on = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1]) & (ref_start[1:] == ref_start[:-1] + 1)
    first = np.append(0, np.flatnonzero(~on) + 1)
    out = np.empty(len(first), dtype=RUN)
    out["start"], out["ref_doc"], out["ref_start"] = start[first], ref_doc[first], ref_start[first]
    out["windows"] = np.diff(np.append(first, len(start)))
    return out, doc[first]


def _same_words(data: np.ndarray, a: int, b: int, c: int, d: int) -> bool:
    """Whether two ranges of bytes hold the same words, whatever lies between them."""
    one, other = data[a:b].tobytes(), data[c:d].tobytes()
    return one == other or one.split() == other.split()


def _sent(ids: np.ndarray, data: np.ndarray, key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first window of each hash here, to be looked up; and by document the runs of the others, which are known from it.

    Runs are compared with their place word by word.  Windows of a run whose words
    differ are looked up like first ones.
    """
    order = np.lexsort((more, key))  # stable: the earliest place of a hash is its first
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    head = np.empty(len(key), dtype=np.int64)
    head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
    look_up = head == np.arange(len(key))
    k = np.flatnonzero(~look_up)
    if len(k):
        runs, owner = _runs(doc[k], place[k], ids[doc[head[k]]], place[head[k]])
        last = np.cumsum(runs["windows"]) - 1
        a, b = k[last - runs["windows"] + 1], k[last]
        ranges = zip(begin[a].tolist(), end[b].tolist(), begin[head[a]].tolist(), end[head[b]].tolist())
        equal = np.fromiter((_same_words(data, *r) for r in ranges), dtype=bool, count=len(runs))
        look_up[k[~np.repeat(equal, runs["windows"])]] = True
        runs, owner = runs[equal], owner[equal]
    names = ["key", "more", "doc_id", "start", "runs"]
    h = np.flatnonzero(look_up)
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[h].view(np.int64)), pa.array(more[h]), pa.array(ids[doc[h]]), pa.array(place[h].astype(np.int32)), pa.nulls(len(h), pa.binary())],
        names=names
    )
    if len(k) and len(runs):
        cut = np.flatnonzero(np.diff(owner)) + 1
        which = ids[owner[np.append(0, cut)]]
        packed = pa.array([x.tobytes() for x in np.split(runs, cut)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(K.mix(which.astype(np.uint64)).view(np.int64)), pa.nulls(len(which), pa.int32()), pa.array(which), pa.nulls(len(which), pa.int32()), packed],
            names=names
        )


def _window_rows(window: int, size: int, seed: int, bits: int) -> Callable:
    low, high = np.uint64((1 << min(bits, 64)) - 1), np.uint64((1 << max(bits - 64, 0)) - 1)

    def rows(batches):
        for batch in batches:
            batch = _ordered(batch.filter(batch.column(3).is_valid()))  # those with anchors to look up
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = K.strings(batch.column(1))
            found = []
            for i, j in K.slices(at):
                text = K.words(data, at[i : j + 1], K.SPACED, False)
                h = text.hashes()
                run, starts, anchor = anchors(h, text.first, window, size)
                live = np.zeros(len(h), dtype=bool)
                for k in range(i, j):
                    live[text.first[k - i] + _unpack(batch.column(2), batch.column(3), k)] = True
                where = np.flatnonzero(starts)
                where = where[live[anchor[where]]]
                doc = np.searchsorted(text.first, where, side="right") - 1
                key = K.grams(K.mix(h + np.uint64(2 * seed)), window)[where] & low
                more = (K.grams(K.mix(h ^ np.uint64(2 * seed + 1)), window)[where] >> np.uint64(33) & high).astype(np.int32)
                found.append((key, more, doc + i, where - text.first[doc], text.start[where] + at[i], text.end[where + window - 1] + at[i]))
            if found:
                yield from _sent(ids, data, *(np.concatenate(x) for x in zip(*found)))

    return rows


def _alone(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a column of lists as runs of one, and each row's offset among them."""
    held = column.flatten()
    out = np.empty(len(held), dtype=RUN)
    out["windows"] = 1
    for k, name in enumerate(("start", "ref_doc", "ref_start")):
        out[name] = held.field(k).to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(lengths)])


def factors(alone: np.ndarray, packed: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """The factors of a document, ascending, as runs of windows; they may overlap by less than a window.

    And of each, whether its words are still to be compared; those of ``packed`` have been.
    """
    runs = np.concatenate([alone, *(np.frombuffer(b, dtype=RUN) for b in packed or [])])
    if not len(runs):
        return runs, np.zeros(0, dtype=bool)
    order = np.argsort(runs["start"], kind="stable")
    runs = runs[order]
    end = runs["start"] + runs["windows"]
    on = (runs["start"][1:] == end[:-1]) & (runs["ref_doc"][1:] == runs["ref_doc"][:-1]) & (runs["ref_start"][1:] == runs["ref_start"][:-1] + runs["windows"][:-1])
    first = np.append(0, np.flatnonzero(~on) + 1)
    out = runs[first].copy()
    out["windows"] = np.add.reduceat(runs["windows"], first)
    return out, np.logical_or.reduceat(order < len(alone), first)


def _asked(window: int) -> Callable:
    """The spans that documents name and have not compared: ``doc_id, start, words``, the document that they lie in."""

    def rows(batches):
        for batch in batches:
            alone, upto = _alone(batch.column(1))
            parts = []
            for k, packed in enumerate(batch.column(2).to_pylist()):
                parse, is_open = factors(alone[upto[k] : upto[k + 1]], packed)
                parts.append(parse[is_open])
            if parts:
                parse = np.concatenate(parts)
                columns = (parse["ref_doc"], parse["ref_start"], parse["windows"] + np.int32(window - 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "words"])

    return rows


def spans(parse: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The words (first, end) that factors cover; factors that touch or overlap are one span."""
    if not len(parse):
        return []
    end = parse["start"] + parse["windows"] + window - 1
    cut = np.flatnonzero(parse["start"][1:] > end[:-1]) + 1
    return [(int(g[0]), int(e[-1])) for g, e in zip(np.split(parse["start"], cut), np.split(end, cut))]


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, seed: int = 0, bits: int = BITS[0]) -> DataFrame:
    """Documents with the places of windows that also start earlier: ``doc_id, text, some, packed, asked``.

    Earlier means a smaller ``doc_id``, or the same document and an earlier word.
    Documents without such windows have nulls.  ``packed`` are runs whose words have
    been compared, ``asked`` the spans (start, words) that factors of other batches
    have in this document, each once.  The text is shuffled once, by id; the look-ups
    and what is asked meet it there.
    """
    size = min(anchor, window)
    text = _docs(docs)
    live = _by_document(_repeated(text.where(F.col("doc_id").isNotNull()).mapInArrow(_anchor_rows(window, size), FOUND)))
    # all joins keep every row of the same side, so Spark shuffles the texts once for all of them
    with_live = text.join(live.hint("shuffle_hash"), "doc_id", "left")
    # the filter that joins would infer stands here, so that the parse and the questions take the same shuffled places
    again = _referred(with_live.mapInArrow(_window_rows(window, size, seed, bits), SENT)).where(F.col("doc_id").isNotNull())
    again = again.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("runs").isNull(), F.struct("start", "ref_doc", "ref_start"))).alias("some"),
        F.collect_list("runs").alias("packed")
    )
    asked = again.mapInArrow(_asked(window), "doc_id long, start int, words int").groupBy("doc_id").agg(F.collect_set(F.struct("start", "words")).alias("asked"))
    return text.join(again.hint("shuffle_hash"), "doc_id", "left").join(asked.hint("shuffle_hash"), "doc_id", "left")


def _digest(text: K.Words, raw: bytes, first: int, end: int) -> bytes:
    """16 bytes that stand for consecutive words."""
    said = b" ".join(raw[text.start[first] : text.end[end - 1]].split())
    return hashlib.blake2b(said, digest_size=16).digest()


def _parsed(docs: DataFrame, window: int, anchor: int, seed: int, bits: int, digests: bool) -> DataFrame:
    """``doc_id, n_words, n_removed, factors, spans, asked, text``: the parse, and the text that is left."""

    def rows(batches):
        for batch in batches:
            data, at = K.strings(batch.column(1))
            alone, upto = _alone(batch.column(2))
            packed, questions = batch.column(3).to_pylist(), batch.column(4)
            n, removed, parses, covered, answers, kept = [], [], [], [], [], []
            for i, j in K.slices(at):
                text = K.words(data, at[i : j + 1], K.SPACED, False)
                raw = text.data.tobytes()
                for k in range(i, j):
                    a, b = int(text.first[k - i]), int(text.first[k - i + 1])
                    parse, is_open = factors(alone[upto[k] : upto[k + 1]], packed[k])
                    mine = spans(parse, window)
                    gone = sum(y - x for x, y in mine)
                    if gone:
                        keep = np.ones(b - a, dtype=bool)
                        for x, y in mine:
                            keep[x:y] = False
                        where = np.flatnonzero(keep) + a
                        said = b" ".join(raw[s:e] for s, e in zip(text.start[where].tolist(), text.end[where].tolist()))
                    else:
                        said = b" ".join(raw[at[k] - at[i] : at[k + 1] - at[i]].split()) if b > a else b""
                    digest = lambda s, words: _digest(text, raw, a + s, a + s + words)  # noqa: B023, E731
                    n.append(b - a)
                    removed.append(gone)
                    parses.append(
                        [
                            {"first": s, "last": s + m + window - 1, "ref_doc": d, "ref_start": r, "digest": digest(s, m + window - 1) if digests and is_new else None}
                            for (s, m, d, r), is_new in zip(parse.tolist(), is_open.tolist())
                        ]
                    )
                    covered.append([{"first": x, "last": y} for x, y in mine])
                    answers.append([x | {"digest": digest(x["start"], x["words"])} for x in questions[k].as_py() or []] if digests else None)
                    kept.append(said)
            factor = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32()), ("digest", pa.binary())])
            span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
            answer = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])
            columns = [
                pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(parses, pa.list_(factor)), pa.array(covered, pa.list_(span)),
                pa.array(answers, pa.list_(answer))
            ]
            names = ["doc_id", "n_words", "n_removed", "factors", "spans", "asked", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    schema = f"doc_id long, n_words long, n_removed long, factors {FACTORS}, spans array<struct<first: int, last: int>>, asked {ASKED}, text string"
    spanned = duplicate_spans(docs, window, anchor, seed, bits)
    return (spanned if digests else spanned.withColumn("asked", F.lit(None).cast("array<struct<start: int, words: int>>"))).mapInArrow(rows, schema)


def false_factors(parsed: DataFrame) -> DataFrame:
    """Spans whose words are not those of a factor that has its place there: ``doc_id, start, words``."""
    f, x = F.col("f"), F.col("x")
    said = parsed.select(F.explode("factors").alias("f")).where(f["digest"].isNotNull())
    said = said.select(
        f["ref_doc"].alias("doc_id"), f["ref_start"].alias("start"), (f["last"] - f["first"]).alias("words"), f["digest"].alias("digest"),
        F.lit(False).alias("there")
    )
    there = parsed.select("doc_id", F.explode("asked").alias("x")).select("doc_id", "x.start", "x.words", "x.digest", F.lit(True).alias("there"))
    both = said.unionByName(there).groupBy("doc_id", "start", "words").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("there").alias("there"))
    return both.where(~F.col("there") | (F.col("low") != F.col("high"))).select("doc_id", "start", "words")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, verify: bool = True, kept: Column | str = "text", bits: tuple[int, ...] = BITS) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_removed, factors, spans`` (word ranges, end exclusive) and the kept ``text``.

    Words are runs without ASCII white space; kept words are joined by one space.
    A null text has no words.  Rows with a null id come out whole, as they have no
    place in the order.  Rows of equal id are documents of their own, in the order of
    their texts; ``ref_doc`` is then a number of the row that is read, by which such
    rows are told apart.  The result is read from a written table; who needs no more
    of the kept text than an expression of it names that as ``kept``, so that texts
    are not written.  Without ``verify`` factors of different batches rest on hashes.
    ``bits`` are the hash bits of each try; fewer force clashes, for tests.
    """
    if docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).count():
        named = docs.select(F.col("doc_id").alias("_doc"), "text").where(F.col("doc_id").isNotNull()).repartitionByRange("_doc", "text").sortWithinPartitions("_doc", "text")
        keyed = stored(named.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")  # ascends with id and text
        out = without_repeats(keyed, window, anchor, verify, kept, bits).join(keyed.select("doc_id", "_doc"), "doc_id")
        out = out.withColumn("doc_id", F.col("_doc").cast("long")).drop("_doc")
        nameless = docs.where(F.col("doc_id").isNull())
        return out.unionByName(without_repeats(nameless, window, anchor, verify, kept, bits))
    result = ["doc_id", "n_words", "n_removed", "factors", "spans"]
    if not verify:
        return _parsed(docs, window, anchor, 0, bits[0], False).select(*result, kept)
    for seed, size in enumerate(bits):
        parsed = stored(_parsed(docs, window, anchor, seed, size, True).select(*result, "asked", kept), "parsed")
        if false_factors(parsed).isEmpty():
            return parsed.drop("asked")
    raise RuntimeError("windows of different words have equal hashes, whatever the hash")


def digested(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document."""
    return without_repeats(docs, window, kept=F.sha2("text", 256).alias("kept_sha256")).select("doc_id", "n_words", "n_removed", "kept_sha256")
