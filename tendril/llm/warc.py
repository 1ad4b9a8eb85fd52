"""WARC files of pages, and a Merkle audit of their replicas.

Pages go to shards of ``PER_SHARD`` consecutive ids.  A shard's records are a plain
stream, which is cut into parts between ids where about ``FILE_BYTES`` are full: the
sums of lengths by id, without any text, tell where a part begins and with which
ordinal and offset, so parts are written by tasks of their own, each to a
``.warc.gz`` file with a ``warcinfo`` record and a gzip member per page.  The
manifest lists every record's place: its ordinal, its range in the plain stream, its
range in the file, and the SHA-256 of its plain bytes.  Files are read and copied in
as many tasks as their bytes ask for, whatever the size of the manifest.

The audit hashes records into a tree: a node holds up to ``FAN`` children in
order, with the offset range that they cover, up to the root of a shard and on to
the root of the archive.  Two replicas are compared from the root; only children
of nodes that differ are looked at, down to the records.  Trees are grouped by
node, with at most ``FAN`` rows in a group, so no task holds a shard's records.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.shared import opened, qualified, shared_path, stored

PER_SHARD = 4096
#: Bytes of pages or files that a task writes, reads or copies, as far as whole parts allow.
TASK_BYTES = 16 << 20
#: Plain bytes after which a shard's next id begins a file; more where there would be more than ``CUTS`` of them.
FILE_BYTES = 16 << 20
CUTS = 100_000
#: What is not known of a page: when it was fetched.
CAPTURED = "1970-01-01T00:00:00Z"
BITS = 4
FAN = 1 << BITS

MANIFEST = "page_id long, shard long, part int, ordinal long, offset long, length long, file_offset long, file_length long, sha256 string"


def record_id(shard: int, ordinal: int) -> str:
    """A UUID from the record's place, which is its alone."""
    h = hashlib.md5(f"{shard}/{ordinal}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-8{h[17:20]}-{h[20:]}"


def record(shard: int, ordinal: int, url: str | None, html: str | None, captured: str = CAPTURED) -> bytes:
    """The plain bytes of a WARC record; nulls are empty, line ends in the URL are percent-encoded."""
    body = (html or "").encode()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id(shard, ordinal)}>\r\nWARC-Date: {captured}\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def info_record(name: str, captured: str = CAPTURED) -> bytes:
    """The record that says what a file is; it belongs to the file and not to the shard's stream."""
    body = b"software: tendril\r\nformat: WARC File Format 1.0\r\n"
    h = hashlib.md5(name.encode()).hexdigest()
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-8{h[17:20]}-{h[20:]}>\r\nWARC-Date: {captured}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record_length(url: Column, html: Column, captured: str = CAPTURED) -> Column:
    """The bytes of ``record``, without making it."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.octet_length(F.coalesce(html, F.lit("")))
    return (F.lit(len(record(0, 0, None, None, captured)) - 1) + F.octet_length(uri) + F.length(size.cast("string")) + size).cast("long")


def file_name(shard: int, part: int) -> str:
    return f"shard-{shard}-{part}.warc.gz" if part else f"shard-{shard}.warc.gz"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _cuts(lengths: DataFrame, size: int) -> DataFrame:
    """``shard, cuts``: the ids at which parts but the first begin, with the records and bytes of the shard before them.

    ``lengths`` has a row for each ``shard, page_id`` with the ``bytes`` and ``n`` of its records.  A shard of B bytes
    has B / ``size`` cuts at most.
    """
    order = Window.partitionBy("shard").orderBy(F.col("page_id").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = lengths.withColumns({"ordinal": F.coalesce(F.sum("n").over(before), F.lit(0)), "offset": F.coalesce(F.sum("bytes").over(before), F.lit(0))})
    at = at.withColumn("part", F.floor(F.col("offset") / size)).withColumn("last", F.lag("part").over(order))
    return at.where(F.col("part") > F.col("last")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("page_id", "ordinal", "offset"))).alias("cuts"))


def write_warc(pages: DataFrame, folder: str, per_shard: int = PER_SHARD, captured: str = CAPTURED, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages; returns the manifest, from a written table.

    Shards hold the ids of one range of ``per_shard``, and have as many files as their
    bytes ask for: an empty range has no file, a range with one id has a file of its
    records.  Rows with a null id are dealt by their contents over shards below 0, as
    many as ``per_shard`` of them need, a file each.  Rows of equal id are records of
    their own, by url and html, in one file; equal rows stay apart too.  Only
    ``page_id, url, html`` are read.
    """
    folder = qualified(pages.sparkSession, folder)
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    nameless = -(-pages.where(F.col("page_id").isNull()).count() // per_shard)
    apart = -1 - F.pmod(F.xxhash64(url, html), F.lit(max(1, nameless)))
    shard = F.coalesce(F.floor(F.col("page_id") / per_shard), apart).cast("long")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), shard.alias("shard"))
    lengths = own.select("shard", "page_id", record_length(F.col("url"), F.col("html"), captured).alias("bytes"))
    lengths = stored(lengths.groupBy("shard", "page_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "warc-lengths")
    size = lengths.agg(F.sum("bytes")).first()[0] or 0
    # cuts are no more than CUTS, so they go to every task
    known = own.join(F.broadcast(_cuts(lengths, max(file_bytes, -(-size // CUTS)))), "shard", "left")
    known = known.withColumn("cuts", F.filter(F.coalesce("cuts", F.array()), lambda c: c["page_id"] <= F.col("page_id")))
    base = F.try_element_at("cuts", F.lit(-1))
    known = known.select(
        "page_id", "url", "html", "shard", F.size("cuts").alias("part"), F.coalesce(base["ordinal"], F.lit(0)).alias("ordinal"),
        F.coalesce(base["offset"], F.lit(0)).alias("offset")
    )
    order = [F.col(c).asc_nulls_first() for c in ("shard", "part", "page_id", "url", "html")]
    dealt = known.repartition(_tasks(pages, size), "shard", "part").sortWithinPartitions(*order)

    def write(batches):
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        name, out = None, None
        ordinal = offset = at = 0

        def close():
            if out is not None:
                out.close()
                fs.move(f"{top}/.{name}-{attempt}", f"{top}/{name}")

        for batch in batches:
            rows = []
            for page_id, url, html, shard, part, first, begin in zip(*(c.to_pylist() for c in batch.columns)):
                if file_name(shard, part) != name:
                    close()
                    name = file_name(shard, part)
                    out = fs.open_output_stream(f"{top}/.{name}-{attempt}", compression=None)
                    info = gzip.compress(info_record(name, captured), mtime=0)
                    out.write(info)
                    ordinal, offset, at = first, begin, len(info)
                plain = record(shard, ordinal, url, html, captured)
                packed = gzip.compress(plain, mtime=0)
                out.write(packed)
                rows.append((page_id, shard, part, ordinal, offset, len(plain), at, len(packed), hashlib.sha256(plain).hexdigest()))
                ordinal, offset, at = ordinal + 1, offset + len(plain), at + len(packed)
            if rows:
                yield _rows(rows, ("page_id", "shard", "part", "ordinal", "offset", "length", "file_offset", "file_length", "sha256"))
        close()

    return stored(dealt.mapInArrow(write, MANIFEST), "warc-manifest")


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"sha256": pa.string(), "part": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(zip(*rows), names)], names=list(names))


def _tasks(df: DataFrame, size: int | None) -> int:
    """Tasks of ``TASK_BYTES`` each, and one for each core at least."""
    return max(math.ceil((size or 0) / TASK_BYTES), df.sparkSession.sparkContext.defaultParallelism)


def _by_bytes(manifest: DataFrame, *columns: Column | str) -> DataFrame:
    """The manifest's rows by file, in tasks by the bytes of the files: its own size says nothing of theirs."""
    size = manifest.agg(F.sum("file_length")).first()[0]
    return manifest.select(*columns).repartition(_tasks(manifest, size), "shard", "part").sortWithinPartitions("shard", "part", "ordinal")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """What a replica's files hold at the manifest's ranges: ``shard, ordinal, offset, length, sha256``.

    A file that is missing, a range that is cut short and a member that does not
    unpack have a null digest.
    """
    folder = qualified(manifest.sparkSession, folder)
    listed = _by_bytes(manifest, "shard", "part", "ordinal", "offset", "length", "file_offset", "file_length")

    def read(batches):
        fs, top = opened(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, part, ordinal, offset, length, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if file_name(shard, part) != name:
                    name = file_name(shard, part)
                    there = fs.get_file_info(f"{top}/{name}").type == pafs.FileType.File
                    file = fs.open_input_file(f"{top}/{name}") if there else None
                rows.append((shard, ordinal, offset, length, _digest(file, at, size)))
            if rows:
                yield _rows(rows, ("shard", "ordinal", "offset", "length", "sha256"))

    return listed.mapInArrow(read, "shard long, ordinal long, offset long, length long, sha256 string")


def _digest(file: pa.NativeFile | None, at: int, size: int) -> str | None:
    if file is None:
        return None
    try:
        return hashlib.sha256(gzip.decompress(file.read_at(size, at))).hexdigest()
    except (OSError, EOFError, zlib.error):
        return None


def copy_warc(manifest: DataFrame, source: str, target: str, damaged: Column) -> DataFrame:
    """A replica of the files, for drills: a bit is turned in the payload of each record where ``damaged``, which is packed again.

    Returns the replica's own manifest, from a written table: the records' places in its files differ.
    """
    source, target = qualified(manifest.sparkSession, source), qualified(manifest.sparkSession, target)
    listed = _by_bytes(manifest, "shard", "part", "ordinal", "file_offset", "file_length", F.coalesce(damaged, F.lit(False)).alias("damaged"), "offset", "length")

    def copy(batches):
        fs, top = opened(source)
        to, to_top = opened(target)
        to.create_dir(to_top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        name, file, out = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                to.move(f"{to_top}/.{name}-{attempt}", f"{to_top}/{name}")

        names, place = ("shard", "part", "ordinal", "offset", "length", "file_offset", "file_length"), 0
        for batch in batches:
            rows = []
            for shard, part, ordinal, at, size, bad, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file_name(shard, part) != name:
                    close()
                    name = file_name(shard, part)
                    file = fs.open_input_file(f"{top}/{name}")
                    out = to.open_output_stream(f"{to_top}/.{name}-{attempt}", compression=None)
                    out.write(file.read_at(at, 0))  # what stands before the first page: the file's own record
                    place = at
                member = file.read_at(size, at)
                if bad:
                    plain = bytearray(gzip.decompress(member))
                    plain[-5] ^= 1  # the payload's last byte, before the record's two line ends
                    member = gzip.compress(bytes(plain), mtime=0)
                out.write(member)
                rows.append((shard, part, ordinal, offset, length, place, len(member)))
                place += len(member)
            if rows:
                yield _rows(rows, names)
        close()

    return stored(listed.mapInArrow(copy, "shard long, part int, ordinal long, offset long, length long, file_offset long, file_length long"), "warc-copy")


def merkle(leaves: DataFrame, per_shard: int = PER_SHARD, top_shard: int | None = None) -> list[DataFrame]:
    """The tree's levels, records first and the root last: ``shard, node, low, high, hash``.

    Within a shard a parent's number is its children's shifted by four bits; above
    the shards' roots the same goes for the shards' numbers.  ``low`` and ``high``
    are the offsets covered.  Replicas must be built with the same ``top_shard``.
    """
    level = stored(
        leaves.select(
            "shard", F.col("ordinal").alias("node"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"),
            F.coalesce("sha256", F.lit("")).alias("hash")
        ),
        "merkle"
    )
    if top_shard is None:
        top_shard = level.agg(F.max("shard")).first()[0] or 0
    levels = [level]

    def up(below: DataFrame, shard: Column, node: Column, order: str) -> DataFrame:
        child = F.struct(F.col(order).alias("at"), "low", "high", "hash")
        said = lambda c: F.concat_ws(":", c["at"].cast("string"), c["low"].cast("string"), c["high"].cast("string"), c["hash"])
        return below.groupBy(shard.alias("shard"), node.alias("node")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), said), ","), 256).alias("hash")
        )

    size = per_shard
    while size > 1:
        levels.append(stored(up(levels[-1], F.col("shard"), F.shiftright("node", BITS), "node"), "merkle"))
        size = -(-size // FAN)
    while True:
        levels.append(stored(up(levels[-1], F.shiftright("shard", BITS), F.lit(0).cast("long"), "shard"), "merkle"))
        top_shard >>= BITS
        if top_shard <= 0:
            return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], per_shard: int = PER_SHARD) -> DataFrame:
    """``shard, ordinal`` of the records in which two trees of the same shape differ.

    Nodes that only one tree has differ.  From the root down, only children of
    nodes that differ are compared.
    """
    inner = 0
    size = per_shard
    while size > 1:
        inner, size = inner + 1, -(-size // FAN)
    bad: DataFrame | None = None
    for k in range(len(ours) - 1, -1, -1):
        one, other = ours[k].select("shard", "node", "hash"), theirs[k].select("shard", "node", F.col("hash").alias("other"))
        if bad is not None:
            parent = [F.col("shard") if k < inner else F.shiftright("shard", BITS), F.shiftright("node", BITS) if k < inner else F.lit(0).cast("long")]
            seen = bad.select(F.col("shard").alias("_shard"), F.col("node").alias("_node"))
            one, other = (t.withColumns({"_shard": parent[0], "_node": parent[1]}).join(seen, ["_shard", "_node"], "left_semi").drop("_shard", "_node") for t in (one, other))
        bad = one.join(other, ["shard", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("shard", "node")
    return bad.select("shard", F.col("node").alias("ordinal"))


def drill(pages: DataFrame, damaged: Column, per_shard: int = PER_SHARD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages``, copies the files with damage where the manifest's rows say ``damaged``, and audits the copy.

    Returns a row per page: ``page_id, shard, ordinal, offset, length, sha256`` and
    ``damaged`` as the audit found it.
    """
    spark = pages.sparkSession
    ours, theirs = shared_path(spark, "warc"), shared_path(spark, "warc-copy")
    manifest = write_warc(pages, ours, per_shard, file_bytes=file_bytes)
    copied = copy_warc(manifest, ours, theirs, damaged)
    top = manifest.agg(F.max("shard")).first()[0] or 0
    found = audit(merkle(manifest, per_shard, top), merkle(read_warc(copied, theirs), per_shard, top), per_shard).withColumn("damaged", F.lit(True))
    return manifest.join(found, ["shard", "ordinal"], "left").select(
        "page_id", "shard", "ordinal", "offset", "length", "sha256", F.coalesce("damaged", F.lit(False)).alias("damaged")
    )
