"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is normalised and turned by two random rotations; the signs of each result
are a code, and with it goes the factor <signs, turned vector>.  Turned back and
divided by its factor, a code is the vector plus an error at right angles to it, of
a length that code and factor tell and of a direction that the rotation makes
random.  So the inner product of a vector's first code with another's second one is
an unbiased estimate of their cosine, and its spread is known: a pair whose upper
confidence bound is below the threshold is dropped, and every other is computed
again exactly, in double precision.

Codes and factors are computed once and stored.  Which pairs meet is decided by
bands, samples of the code's bits: two vectors are compared in the first band in
which their bits agree.  Only ids, codes and factors are dealt by band.  The groups
of a band name the vectors of the pairs that their bounds leave, and those alone are
fetched, for these groups.  Bits and bands follow from the number of distinct
vectors and from ``RECALL`` at the threshold.

Equal vectors are one vector with a count.  A band's group of more than ``GROUP``
rows is dealt as pairs of parts of at most that size, so no task holds a group and
none is cut; links are added up by vector where they are found, never laid out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.components import components
from tendril.llm.shared import classed, dealt, stored

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold meets in some band; closer pairs meet more surely.
RECALL = 0.999
#: Standard deviations of the estimate's error that the upper bound allows for.
CONFIDENCE = 5.0
#: Bits of each of the two codes, at least; there is one for each component besides.
CODE_BITS = 256
GROUP = 4096
SEED = 11
_BLOCK = 256

CODES = "rep long, least long, copies long, h long, h2 long, width int, code binary, factor0 float, factor1 float, v binary"
BAND = "band long, bits long, rep long, code binary, factor0 float, factor1 float"


def code_bits(width: int) -> int:
    """Bits of one code of a vector of ``width`` components."""
    return 64 * -(-max(CODE_BITS, width) // 64)


@lru_cache(maxsize=8)
def rotations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions of the first code's bits and of the second's: rows of random rotations of the space."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    out = []
    for _ in range(2):
        parts = []
        for _ in range(-(-code_bits(width) // width)):
            q, r = np.linalg.qr(rng.standard_normal((width, width)))
            parts.append(q * np.sign(np.diag(r)))
        out.append(np.concatenate(parts)[: code_bits(width)])
    return out[0], out[1]


def bands_for(n: int, width: int = 64, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands for ``n`` vectors.

    Groups grow with the fourth root of ``n``, so that bands stay few.  The bits in
    which a pair differs are taken to spread as independent ones do, which is more
    than they do.
    """
    size = 2 * code_bits(width)
    bits = min(40, max(4, round(0.75 * math.log2(max(n, 2))) - 4))
    part = math.acos(threshold) / math.pi
    differ = np.arange(size - bits + 1)
    log = np.array([math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) for k in differ]) + differ * math.log(part) + (size - differ) * math.log(1 - part)
    agree = np.prod([(size - differ - k) / (size - k) for k in range(bits)], axis=0)
    missed = lambda bands: float(np.exp(log) @ (1 - agree) ** bands)
    bands = 1
    while missed(bands) > 1 - recall:
        bands *= 2
    low = bands // 2
    while bands - low > 1:
        at = (bands + low) // 2
        low, bands = (at, bands) if missed(at) > 1 - recall else (low, at)
    return bits, bands


@lru_cache(maxsize=8)
def samples(width: int, bits: int, bands: int) -> np.ndarray:
    """The bits of the code that each band looks at."""
    rng = np.random.Generator(np.random.PCG64([SEED, width]))
    return np.stack([rng.permutation(2 * code_bits(width))[:bits] for _ in range(bands)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _plain(column: str) -> Column:
    """The components as they are, floats or doubles, without negative zeros."""
    return F.transform(F.col(column), lambda x: x + F.lit(0).cast("float"))


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Usable vectors, one for each value: ``least`` (its smallest id), ``copies, v``; and nothing of the others.

    Vectors that are null, empty, zero or hold null or non-finite components are left out.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _plain("embedding").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    return usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both codes of unit vectors, a row of packed bits for each, and the two factors."""
    turned = [x @ r.T for r in rotations(x.shape[1])]
    code = np.packbits(np.concatenate(turned, axis=1) >= 0, axis=1)
    return code, np.stack([np.abs(t).sum(axis=1) for t in turned], axis=1).astype(np.float32)


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``v, rep, least, copies, h, h2``: the vectors' codes and factors."""
    for batch in batches:
        sizes = np.asarray(batch.column(0).value_lengths())
        for width in np.unique(sizes):
            part = batch.take(pa.array(np.flatnonzero(sizes == width)))
            n, width = part.num_rows, int(width)
            own = np.asarray(part.column(0).flatten()).reshape(n, width)
            code, factor = encode(_unit(own.astype(np.float64)))
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (code, own)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(np.full(n, width, dtype=np.int32)), packed[0], pa.array(factor[:, 0]), pa.array(factor[:, 1]), packed[1]],
                names=["rep", "least", "copies", "h", "h2", "width", "code", "factor0", "factor1", "v"],
            )


def _bits_of(code: pa.Array) -> np.ndarray:
    """The signs, a row for each code; all are of one length."""
    return np.unpackbits(np.frombuffer(b"".join(code.to_pylist()), dtype=np.uint8).reshape(len(code), -1), axis=1)


def _keys(signs: np.ndarray, width: int, bits: int, bands: int) -> np.ndarray:
    return (signs[:, samples(width, bits, bands)].astype(np.int64) << np.arange(bits)).sum(axis=2)


def _band_rows(bits: int, bands: int, slim: bool):
    """For each vector a row per band: the band, its bits, and code and factors; only the first two if ``slim``."""

    def rows(batches):
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    keys = _keys(_bits_of(some.column(2)), int(width), bits, bands)
                    for band in range(bands):
                        own = [pa.array(np.full(some.num_rows, int(width) << 16 | band)), pa.array(keys[:, band])]
                        rest = [] if slim else [some.column(0), *some.columns[2:5]]
                        yield pa.RecordBatch.from_arrays(own + rest, names=["band", "bits", "rep", "code", "factor0", "factor1"][: len(own + rest)])

    return rows


class Side:
    """The vectors of one part of a group, as their codes tell of them."""

    def __init__(self, group: dict, k: np.ndarray, width: int, bits: int, bands: int):
        self.rep = group["rep"][k]
        signs = _bits_of(group["code"].take(pa.array(k)))
        self.keys = _keys(signs, width, bits, bands)
        half = code_bits(width)
        self.freedom = max(width - 1, 1)
        self.turned, self.spread2 = [], []
        for h, r in enumerate(rotations(width)):
            back = (signs[:, h * half : (h + 1) * half] * np.float32(2) - np.float32(1)) @ r.astype(np.float32) / group[f"factor{h}"][k][:, None]
            self.turned.append(back)
            self.spread2.append(np.maximum(np.einsum("ij,ij->i", back, back) - 1, 0) / self.freedom)
        if "v" in group:
            self.copies = group["copies"][k]
            raw = b"".join(group["v"].take(pa.array(k)).to_pylist())
            self.x = _unit(np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * width * len(k) else "<f8").reshape(len(k), width).astype(np.float64))


def estimates(a: Side, b: Side, k: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of ``a``'s rows ``k`` with all of ``b``, and their error's standard deviation at the threshold."""
    said = (a.turned[0][k] @ b.turned[1].T + a.turned[1][k] @ b.turned[0].T) / 2
    (a0, a1), (b0, b1) = (s[k][:, None] for s in a.spread2), b.spread2
    variance = (1 - threshold**2) * (a0 + a1 + b0 + b1) + a.freedom * (a0 * b1 + a1 * b0)
    return said, np.sqrt(variance) / 2


def possible_pairs(a: Side, b: Side, band: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs whose bounds reach the threshold and that this band is the first to hold."""
    parts = []
    for at in range(0, len(a.rep), _BLOCK):
        said, spread = estimates(a, b, slice(at, at + _BLOCK), threshold)
        i, j = np.nonzero(said + CONFIDENCE * spread + 1e-4 >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for earlier in range(band):
            if not len(i):
                break
            first = a.keys[i, earlier] != b.keys[j, earlier]
            i, j = i[first], j[first]
        parts.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _sides(group: dict, width: int, bits: int, bands: int) -> tuple[Side, Side]:
    sides = [Side(group, np.flatnonzero(group["half"] == h), width, bits, bands) for h in np.unique(group["half"])]
    return sides[0], sides[-1]


def _wanted(threshold: float, bits: int, bands: int):
    """The vectors of each cell that exact computation needs: ``band, bits, cell, half, rep``."""

    def rows(batches):
        for key, group in _groups(batches, ("half", "rep", "factor0", "factor1"), ("code",)):
            a, b = _sides(group, key[0] >> 16, bits, bands)
            i, j = possible_pairs(a, b, key[0] & 0xFFFF, a is b, threshold)
            if a is b:
                i = j = np.union1d(i, j)
            sides = [(0, a.rep[np.unique(i)])] + ([] if a is b else [(1, b.rep[np.unique(j)])])
            for half, rep in sides:
                if len(rep):
                    k = np.full(len(rep), 1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(k * x) for x in key), pa.array(np.full(len(rep), half, dtype=np.int32)), pa.array(rep)],
                        names=["band", "bits", "cell", "half", "rep"]
                    )

    return rows


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position reachable from each position."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def _exact(threshold: float, bits: int, bands: int):
    """Cells with vectors: links counted by vector, and a spanning forest of the links."""

    def rows(batches):
        for key, group in _groups(batches, ("half", "rep", "factor0", "factor1", "copies"), ("code", "v")):
            a, b = _sides(group, key[0] >> 16, bits, bands)
            i, j = possible_pairs(a, b, key[0] & 0xFFFF, a is b, threshold)
            keep = [np.einsum("ij,ij->i", a.x[i[k : k + 65536]], b.x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
            if not keep or not (keep := np.concatenate(keep)).any():
                continue
            i, j = i[keep], j[keep]
            rep, copies = (a.rep, a.copies) if a is b else (np.concatenate([a.rep, b.rep]), np.concatenate([a.copies, b.copies]))
            if a is not b:
                j = j + len(a.rep)
            n = len(rep)
            links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
            order = np.argsort(rep, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)
            root = rep[order[_forest(n, rank[i], rank[j])[rank]]]
            k = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(root[k]), pa.array(links[k].astype(np.int64))], names=["rep", "root", "links"])

    return rows


def _groups(batches, plain: tuple[str, ...], packed: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """Consecutive rows of one (band, bits, cell) if there are several; a group has at most two parts."""
    held: pa.Table | None = None

    def columns(t: pa.Table) -> dict:
        return {n: t.column(n).to_numpy() for n in plain} | {n: t.column(n).combine_chunks() for n in packed}

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        cols = np.stack([table.column(n).to_numpy() for n in ("band", "bits", "cell")])
        cut = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
        edges = [0, *cut.tolist(), table.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1]):
            if b - a > 1:
                yield tuple(cols[:, a].tolist()), columns(table.slice(a, b - a))
        held = table.slice(edges[-2]).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield tuple(held.column(n)[0].as_py() for n in ("band", "bits", "cell")), columns(held)


def link_counts(codes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Links by distinct vector and their components: ``rep, links`` and ``node, component``; all by ``rep``, a vector's number.

    ``codes`` is a written table of ``CODES``.
    """
    n, width = codes.agg(F.count("*"), F.min("width")).first()
    bits, bands = bands_for(n, width or 1, threshold, recall)
    cell = ["band", "bits", "cell"]
    seen = codes.select("rep", "width", "code", "factor0", "factor1")
    sizes = seen.mapInArrow(_band_rows(bits, bands, True), "band long, bits long").groupBy("band", "bits").agg(F.count("*").alias("_n"))
    rows = dealt(seen.mapInArrow(_band_rows(bits, bands, False), BAND), sizes, ["band", "bits"], "rep", GROUP)
    cells = rows.repartition(*cell).sortWithinPartitions(*cell, "half")
    wanted = stored(cells.mapInArrow(_wanted(threshold, bits, bands), "band long, bits long, cell long, half int, rep long"), "wanted")
    whole = wanted.join(codes.select("rep", "copies", "code", "factor0", "factor1", "v"), "rep").repartition(*cell).sortWithinPartitions(*cell, "half")
    found = stored(whole.mapInArrow(_exact(threshold, bits, bands), "rep long, root long, links long"), "vector-links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings`` (``vec_id, embedding``).

    Links join vectors with cosine of at least ``threshold``; copies of a vector
    link with each other.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths do not
    link.  Rows of equal id are rows of their own: each counts as a vector and has
    its vector's answer.  Rows with a null id link with nothing.  Other columns are
    not read.
    """
    hashes = lambda v: [F.xxhash64(v).alias("h"), F.xxhash64(F.lit(SEED), v).alias("h2")]
    numbered = distinct_vectors(embeddings).select("v", F.monotonically_increasing_id().alias("rep"), "least", "copies", *hashes("v"))
    codes = stored(numbered.mapInArrow(_code_rows, CODES), "vector-codes")
    links, found = link_counts(codes, threshold, recall)
    total = embeddings.count()
    found = stored(found.withColumnRenamed("node", "rep").join(codes.select("rep", "least"), "rep"), "found")
    smallest = stored(found.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    found = classed(found.drop("least"), smallest, ["component"], "n", total).select("rep", "component_id")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), _plain("embedding").alias("_v"))
    rows = rows.select("vec_id", *[F.when(F.col("vec_id").isNotNull() & _usable(F.col("_v")), h).alias(n) for h, n in zip(hashes("_v"), ("h", "h2"))])
    answers = codes.select("rep", "least", "copies", "h", "h2").join(links, "rep", "left").join(found, "rep", "left")
    answers = answers.select("h", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    answers = stored(answers.where(F.col("n_links") > 0), "vector-answers")
    out = classed(rows, answers, ["h", "h2"], "copies", total).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
