"""Language identification by cross-parsing entropy.

For each language the suffix automaton of some of its text is built.  A text is
parsed from left to right into the longest phrases that occur in that text; the
fewer phrases a text needs for its symbols, the nearer it is to the language.
Phrases over symbols estimate the cross entropy, and the least wins.

The automata are compiled to transition tables in which a step that leaves the
automaton starts a new phrase, so that thousands of stretches of text advance
together, a symbol at a time, by array look-ups.  Texts are parsed whole, in
stretches of ``STRETCH`` symbols that each begin a phrase, for every language at the
same places.  There is no shuffle but that of the bounded sample.

The sample is bounded whatever the size of the table: by the documents of each language
(``DOCUMENTS``), by the symbols of each (``SYMBOLS``, in equal shares of its documents, from
a place in each that its id's hash names), and by those of all together (``ALL_SYMBOLS``).
Every label value is learnt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.llm import kernels as K
from tendril.llm.quality import held_out
from tendril.llm.shared import small_batches, stored

#: Symbols of training text for one language, and for all together; with very many languages each has an equal share.
SYMBOLS, ALL_SYMBOLS = 16_000, 64_000_000
#: Documents from which a language's text is taken, at most.
DOCUMENTS = 64
#: Languages whose automata a Python worker holds, at 4 MB each; texts of more languages are parsed in as many passes.
LANGUAGES_AT_ONCE = 128
STRETCH = 256
UNKNOWN = "und"

_WIDTH = 64
_PAD = 63
#: 0 for whatever is no letter; ASCII letters without case; UTF-8 lead bytes; continuation bytes by their low bits, so that most upper and lower case meet.
SYMBOL = np.zeros(256, dtype=np.uint8)
for _b in range(26):
    SYMBOL[65 + _b] = SYMBOL[97 + _b] = 1 + _b
for _b in range(0xC2, 0xF5):
    SYMBOL[_b] = 27 + _b % 5
for _b in range(0x80, 0xC0):
    SYMBOL[_b] = 32 + min(_b & 0x1F, 30)

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of consecutive texts, runs of non-letters as one, and the texts' offsets among them."""
    own = at - at[0]
    s = SYMBOL[data[at[0] : at[-1]]]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], upto[own]


def automaton(text: np.ndarray) -> np.ndarray:
    """The transition table, flattened: state * 64 + symbol to state, its highest bit set where a phrase begins; 16 bits if states fit."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text.tolist():
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    kind = np.uint16 if len(step) <= 1 << 15 else np.uint32
    new = 1 << 8 * np.dtype(kind).itemsize - 1
    root = np.full(_WIDTH, new, dtype=kind)  # a symbol that never occurs is a phrase of its own
    for c, to in step[0].items():
        root[c] = to | new
    root[_PAD] = 0
    table = np.tile(root, (len(step), 1))
    for state, edges in enumerate(step):
        for c, to in edges.items():
            table[state, c] = to
    for c, to in step[0].items():
        table[0, c] = to | new
    table[:, _PAD] = np.arange(len(step), dtype=kind)
    return table.ravel()


_TABLES: dict[str, list[np.ndarray]] = {}


def tables_of(texts: list[bytes]) -> list[np.ndarray]:
    """Compiled once in each worker process."""
    key = hashlib.sha256(b"\0".join(texts)).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = [automaton(np.frombuffer(t, dtype=np.uint8)) for t in texts]
    return _TABLES[key]


def phrases(tables: list[np.ndarray], s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases that each text needs, a column for each language."""
    size = np.diff(at)
    stretches = (size + STRETCH - 1) // STRETCH
    doc = np.repeat(np.arange(len(size)), stretches)
    out = np.zeros((len(size), len(tables)), dtype=np.int64)
    if not len(doc):
        return out
    k = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    start = at[:-1][doc] + k * STRETCH
    left = np.minimum(at[1:][doc] - start, STRETCH)
    grid = np.minimum(start + np.arange(int(left.max()))[:, None], len(s) - 1)
    lanes = np.where(np.arange(len(grid))[:, None] < left, s[grid], _PAD).astype(np.int32)
    for column, table in enumerate(tables):
        shift = 8 * table.itemsize - 1
        wide = np.int32 if shift == 15 else np.int64
        state = np.zeros(len(doc), dtype=wide)
        count = np.zeros(len(doc), dtype=np.int32)
        for row in lanes.astype(wide, copy=False):
            to = table[(state << 6) | row]
            count += (to >> shift).astype(np.int32)
            state = (to & ((1 << shift) - 1)).astype(wide)
        out[:, column] = np.bincount(doc, weights=count, minlength=len(size)).astype(np.int64)
    return out


def learn(docs: DataFrame, folds: int = 3, fold: int = 1, symbols_each: int = SYMBOLS, documents: int = DOCUMENTS, all_symbols: int = ALL_SYMBOLS) -> dict[str, bytes]:
    """Training symbols by language, from documents outside ``fold`` whose language is known.

    Every label value is learnt.  Only documents with letters are sampled, by the hash of
    their ids.  The driver gets two characters a symbol at most, and ``all_symbols``
    symbols of all languages together.
    """
    lang, text, ident = F.col("lang").cast("string"), F.col("text").cast("string"), F.col("doc_id")
    named = docs.select(ident.alias("doc_id"), lang.alias("lang"), text.alias("text")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)
    )
    lettered = named.where(F.col("text").rlike(r"\p{L}"))
    number = max(1, lettered.select("lang").distinct().count())
    symbols_each = max(1, min(symbols_each, all_symbols // number))
    documents = max(1, min(documents, symbols_each // 2))
    long = 2 * symbols_each
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - long + 1)).cast("int") + 1
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = lettered.select(
        "lang", "doc_id", F.substring(F.col("text"), place, F.lit(long)).alias("text")
    ).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= documents)
    sample = sample.withColumn("n", F.count("*").over(Window.partitionBy("lang")))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.select("lang", "k", F.left("text", F.ceil(F.lit(long) / F.col("n")).cast("int")).alias("text")).collect():
        texts.setdefault(r.lang, []).append((r.k, r.text))
    out = {}
    for name in sorted(texts):
        share = max(1, symbols_each // len(texts[name]) - 1)  # and a symbol that ends it
        parts = []
        for _, said in sorted(texts[name]):
            data = np.frombuffer(said.encode(), dtype=np.uint8)
            s, _ = symbols(data, np.array([0, len(data)]))
            parts.append(s[:share].tobytes() + b"\0")
        if any(map(any, parts)):
            out[name] = b"".join(parts)
    return out


#: More phrases than any text needs.
_MANY = np.int64(1) << np.int64(62)


def _lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    upto = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data[at[0] : at[-1]]])])[at - at[0]]
    known = np.diff(upto) > 0
    for k in np.flatnonzero(~known & (np.diff(at) > 0)):
        known[k] = bool(_LETTER.search(data[at[k] : at[k + 1]].tobytes().decode(errors="replace")))
    return known


def identify(docs: DataFrame, model: dict[str, bytes], at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row's whole text.

    ``und`` with score 0 for texts that are null or without letters, and for all
    if no language was learnt.  The score is 1 - phrases(best) / phrases(second),
    1 if only one language is known; ties go to the language that sorts first.
    With more languages than ``at_once`` the texts are parsed in several passes, each
    with some of them, between which what was found is written.
    """
    small_batches(docs.sparkSession)
    names = sorted(model)
    parts = [names[k : k + at_once] for k in range(0, len(names), at_once)] or [[]]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        found = rows.mapInArrow(
            _parsed(part, [model[n] for n in part], k == 0, last), f"doc_id long, text string, {FOUND}" if not last
            else f"doc_id long, letters boolean, {FOUND}"
        )
        rows = found if last else stored(found, "languages")
    known = F.col("letters") & F.col("best").isNotNull()
    score = F.when(F.col("second").isNull(), 1.0).otherwise(1 - F.col("least") / F.greatest(F.col("second"), F.lit(1)))
    return rows.select("doc_id", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"))


#: What is known after some languages: the one with fewest phrases, its phrases, and those of the second.
FOUND = "best string, least long, second long"


def _parsed(names: list[str], texts: list[bytes], first: bool, last: bool):
    """A pass over the texts with the automata of some languages, from what passes before have found."""

    def rows(batches):
        tables = tables_of(texts)
        for batch in batches:
            data, at = K.strings(batch.column(1))
            held = None if first else [batch.column(c) for c in (2, 3, 4)]
            for i, j in K.slices(at):
                n = j - i
                best, least, second = np.full(n, -1), np.full(n, _MANY), np.full(n, _MANY)
                if names:
                    count = phrases(tables, *symbols(data, at[i : j + 1]))
                    best = count.argmin(axis=1)
                    least = count[np.arange(n), best]
                    if len(names) > 1:
                        count[np.arange(n), best] = _MANY
                        second = count.min(axis=1)
                label = [names[b] if b >= 0 else None for b in best]
                if held is not None:  # earlier languages win ties
                    old = [c.slice(i, n).fill_null(_MANY).to_numpy() for c in held[1:]]
                    loses = old[0] <= least
                    second = np.where(loses, np.minimum(old[1], least), np.minimum(old[0], second))
                    least = np.where(loses, old[0], least)
                    label = [o if lost else b for o, b, lost in zip(held[0].slice(i, n).to_pylist(), label, loses)]
                shown = [pa.array(label, pa.string()), *(pa.array(x.astype(np.int64), mask=x >= _MANY) for x in (least, second))]
                said = pa.array(_lettered(data, at[i : j + 1])) if last else batch.column(1).slice(i, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), said, *shown], names=["doc_id", "letters" if last else "text", "best", "least", "second"])

    return rows


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
