"""Document quality by pairwise ranking (Bradley-Terry).

A pair is a document that is marked good and one that is marked bad; the model
says the good one wins with probability sigmoid(w.(f(good) - f(bad))), and w
maximises the likelihood of the pairs with a small ridge penalty.  A document's
strength is w.f(text); the cut is the quantile of the labelled strengths that
equals the share of bad labels, and scores are the logistic of the distance from
it, so that ``THRESHOLD`` is reached at the cut.

Features come from the text alone: shares of bytes and words, repetition, and
hashed counts of words, pairs of words and runs of three bytes, all weighed by the
same pairs.  Scoring is one pass over the documents where they lie, without a
shuffle.
Learning reads the texts of a bounded sample of labelled rows (``SAMPLE`` a class,
by the hash of the id), which is also what is sent to the executors and back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernels as K
from tendril.llm.shared import small_batches

#: Labelled rows of each class from which the model is learnt, at most.
SAMPLE = 4000
PAIRS = 40_000
#: Ridge penalty of the weights of shares, and of hashed counts.
RIDGE, RIDGE_HASHED = 1e-3, 1e-1
#: Buckets of hashed words and word pairs, and of runs of three bytes; powers of two.
WORD_BUCKETS, BYTE_BUCKETS = 256, 256
THRESHOLD = 0.3

_KIND = np.full(256, 3, dtype=np.uint8)  # ASCII signs
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*b" \t\n\r\v\f"]] = 4
_KIND[[*b".,;:'\"?!-()"]] = 5
FEATURES = (
    "upper", "digit", "sign", "space", "punctuation", "same_as_before", "repeated", "sign_words", "upper_words", "shouted", "word_length", "size",
    "lines_repeated", "empty"
)


WIDTH = len(FEATURES) + WORD_BUCKETS + BYTE_BUCKETS


def features(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text: ``FEATURES``, words, bytes; null is empty."""
    data, at = K.strings(column)
    out = [np.concatenate([_features(data, at[i : j + 1]), _hashed(data, at[i : j + 1])], axis=1).astype(np.float32) for i, j in K.slices(at)]
    return np.concatenate(out) if out else np.zeros((0, WIDTH), dtype=np.float32)


def _bits(n: int) -> int:
    return n.bit_length() - 1


def _hashed(bytes_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the shares of words and word pairs, and of runs of three bytes, in each bucket."""
    n = len(at) - 1
    text = K.words(bytes_, at, K.SPACED, True)
    h = text.hashes()
    doc = np.repeat(np.arange(n), np.diff(text.first))
    both = K.grams(h, 2)
    inside = doc[1:] == doc[:-1]
    terms, owner = np.concatenate([h, both[inside]]), np.concatenate([doc, doc[1:][inside]])
    words = np.bincount(owner * WORD_BUCKETS + (terms >> np.uint64(64 - _bits(WORD_BUCKETS))).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    grams = np.zeros(n * BYTE_BUCKETS, dtype=np.int64)
    own = at - at[0]
    for a in range(0, max(len(text.data) - 2, 0), K.SLICE_BYTES):  # a long text in stretches
        data = text.data[a : a + K.SLICE_BYTES + 2].astype(np.uint32)
        runs = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        owner = np.searchsorted(own, np.arange(a, a + len(data)), side="right") - 1
        inside = owner[2:] == owner[:-2]
        place = (runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _bits(BYTE_BUCKETS))
        grams += np.bincount(owner[2:][inside] * BYTE_BUCKETS + place[inside], minlength=n * BYTE_BUCKETS)
    grams = grams.reshape(n, BYTE_BUCKETS)
    return np.concatenate([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (words, grams)], axis=1)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[first[1:]] - upto[first[:-1]]


def _features(bytes_: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    own = at - at[0]
    text = K.words(bytes_, at, K.SPACED, False)
    data, first = text.data, text.first
    n_bytes, n_words = np.maximum(np.diff(own), 1), np.maximum(np.diff(first), 1)
    kinds = _KIND[data]
    share = [_per_doc(kinds == k, own) / n_bytes for k in (1, 2, 3, 4, 5)]
    h = text.hashes()
    doc = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    seen = np.zeros(len(h), dtype=bool)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    size = text.end - text.start

    def in_words(flag: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flag)])
        return upto[text.end] - upto[text.start]

    signs, upper = in_words(kinds == 3), in_words(kinds == 1)
    lines = K.words(bytes_, at, K.byte_class([(10, 10)]), False)
    lh = lines.hashes()
    ldoc = np.repeat(np.arange(n), np.diff(lines.first))
    lorder = np.lexsort((lh, ldoc))
    again = np.zeros(len(lh), dtype=bool)
    again[lorder[1:]] = (lh[lorder[1:]] == lh[lorder[:-1]]) & (ldoc[lorder[1:]] == ldoc[lorder[:-1]])
    columns = [
        *share,
        _per_doc(same, first) / n_words,
        _per_doc(seen, first) / n_words / np.log2(n_words + 2),
        _per_doc(signs > 0, first) / n_words,
        _per_doc((upper == size) & (size > 1), first) / n_words,
        _per_doc((data == 33) | (data == 63), own) / n_bytes,
        np.minimum(_per_doc(size, first) / n_words, 40) / 10,
        np.log1p(np.diff(first)) / 10,
        _per_doc(again, lines.first) / np.maximum(np.diff(lines.first), 1),
        (np.diff(first) == 0).astype(float),
    ]
    x = np.stack(columns, axis=1)
    return np.concatenate([np.sqrt(np.maximum(x[:, :12], 0)), x[:, 12:]], axis=1)


def preferences(x: np.ndarray, wins: np.ndarray, loses: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The weights that make rows ``wins`` of ``x`` most likely preferred to rows ``loses``, less the ridge penalty.

    Newton steps by conjugate gradients: pairs are never laid out, their terms are
    added up by row.
    """
    n, pairs = len(x), len(wins)

    def back(c: np.ndarray) -> np.ndarray:
        return (np.bincount(wins, weights=c, minlength=n) - np.bincount(loses, weights=c, minlength=n)) @ x / pairs

    w = np.zeros(x.shape[1])
    for _ in range(30):
        s = x @ w
        p = 1 / (1 + np.exp(-np.clip(s[wins] - s[loses], -30, 30)))
        gradient, weight = back(1 - p) - ridge * w, p * (1 - p)
        if np.abs(gradient).max() < 1e-7:
            break
        step, rest = np.zeros_like(w), gradient.copy()
        along, size = rest.copy(), float(rest @ rest)
        least = 1e-6 * size
        for _ in range(60):
            s = x @ along
            curved = back(weight * (s[wins] - s[loses])) + ridge * along
            length = size / float(along @ curved)
            step, rest = step + length * along, rest - length * curved
            size, before = float(rest @ rest), size
            if size < least:
                break
            along = rest + size / before * along
        w = w + step
    return w


class BradleyTerry:
    """Strengths by features, learnt from preference pairs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weight, self.cut, self.slope = mean, scale, weight, cut, slope

    @classmethod
    def fit(cls, good: np.ndarray, bad: np.ndarray, bad_share: float) -> BradleyTerry:
        width = good.shape[1]
        if not len(good) or not len(bad):  # nothing to compare: every text scores the same, above the threshold
            return cls(np.zeros(width), np.ones(width), np.zeros(width), -1.0, 1.0)
        every = np.concatenate([good, bad])
        mean, scale = every.mean(axis=0, dtype=np.float64), np.maximum(every.std(axis=0, dtype=np.float64), 1e-3)
        rng = np.random.Generator(np.random.PCG64(7))
        pairs = min(PAIRS, 40 * len(every))
        x = (every - mean) / scale
        wins, loses = rng.permutation(pairs) % len(good), len(good) + rng.permutation(pairs) % len(bad)
        w = preferences(x, wins, loses, np.where(np.arange(width) < len(FEATURES), RIDGE, RIDGE_HASHED))
        better, worse = x[: len(good)], x[len(good) :]
        strength = np.concatenate([better @ w, worse @ w])
        weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
        order = np.argsort(strength, kind="stable")
        upto = np.cumsum(weight[order])
        k = min(int(np.searchsorted(upto, bad_share - 1e-9)), len(order) - 1)
        cut = float(strength[order[k]] + strength[order[min(k + 1, len(order) - 1)]]) / 2
        return cls(mean, scale, w, cut, 1.0)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at = math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + at, -40, 40)))


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id's digits falls in ``fold``; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> BradleyTerry:
    """The model of the labelled documents outside ``fold``.

    Labels that are null or neither 0 nor 1 are passed over, as are null ids and
    ids without a document; a document with contradicting labels stands in both
    classes.  Without one of the classes all texts score alike.
    """
    small_batches(docs.sparkSession)
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)
    ).distinct()
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    chosen = None
    for q in (0, 1):
        part = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    def rows(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    # 2 * sample ids at most: they are sent to every executor
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = sorted(tuple(r) for r in read.mapInArrow(rows, "quality int, x binary").collect())  # the order in which tasks end must not show
    x = np.frombuffer(b"".join(x for _, x in got), dtype=np.float32).reshape(-1, WIDTH)
    good = np.array([q == 1 for q, _ in got], dtype=bool)
    return BradleyTerry.fit(x[good], x[~good], counts.get(0, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: BradleyTerry, name: str = "score") -> DataFrame:
    """``doc_id`` and the score of every row's whole text; null and empty texts have one too."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))), pa.float64())], names=["doc_id", name])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id long, {name} double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold: one pass, no join."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels)
    schema = docs.schema
    names = docs.columns

    def rows(batches):
        for batch in batches:
            keep = model.score(features(batch.column(names.index("text")))) >= THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(rows, schema)
