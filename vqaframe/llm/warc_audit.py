"""WARC archives and a Merkle fixity audit of their replicas.

Method: records are hashed; the hashes of a file's records, in the order of their offsets, become the
leaves of a tree whose nodes hash 16 children each. Replicas compare roots; only below nodes that differ
are the next nodes compared, down to the records, which gives the damaged offset ranges.

Records are cut into files of at most ``per_file`` by their place in the input, so a file's size and a tree
node's children are bounded whatever the keys, and nothing is shuffled to write them. Files are written and
read by Spark's own sources, so any store that Spark reaches will do. Each record is a gzip member of its own and
an empty member ends the file; offsets count uncompressed bytes.

Bytes that cannot be unpacked are one differing leaf up to the next member that can, or to the next start of a
member as written here, and the records after them keep their places; such a leaf's length counts stored bytes. A
file that the store itself refuses to read whole (its own checksums) counts as lacking.

Defined results: null url or html are written as empty; repeated rows are records of their own; an empty table
has no files and no rows. A replica whose file lacks records or has more differs from the first of those on; records
and files that only the other replica has are rows too, without an id. Several stored files of one number are read
one after the other by name.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.llm.common import materialise, python_ready
from vqaframe.session import shared_dir

FANOUT = 16
_EOL = "\r\n"
_TAIL = (_EOL * 2).encode()
_END = gzip.compress(b"", mtime=0)  # its last byte is 0
_START = _END[:8]  # of each member written here
_CHUNK = 1 << 16


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            per_file: int = 512) -> DataFrame:
    """``file``, ``place``, ``id``, ``record``: each page as one WARC resource record, without the two line ends after it."""
    at = F.monotonically_increasing_id()
    url = F.regexp_replace(F.coalesce(pages[f"`{url_col}`"].cast("string"), F.lit("")), r"[\r\n]", " ")
    body = F.coalesce(pages[f"`{body_col}`"].cast("string"), F.lit(""))
    base = pages.select(pages[f"`{id_col}`"].alias("id"), at.alias("at"), url.alias("url"), body.alias("body"))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Target-URI: "), "url"),
             F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("at").cast("string"), F.lit(">")),
             "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length("body").cast("string"))]
    head = F.concat(*[F.concat(F.lit(x) if isinstance(x, str) else x, F.lit(_EOL)) for x in lines])
    return base.select((part * (1 << 24) + F.floor(place / per_file)).alias("file"), (place % per_file).cast("int").alias("place"),
                       "id", F.concat(head, F.lit(_EOL), F.col("body")).alias("record"))


def _with_starts(leaves: DataFrame) -> DataFrame:
    before = F.sum(F.col("length")).over(Window.partitionBy("file").orderBy("place")
                                         .rowsBetween(Window.unboundedPreceding, -1))
    return leaves.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def leaves_of_records(recs: DataFrame) -> DataFrame:
    """``file``, ``place``, ``id``, ``start``, ``length``, ``hash`` of records as they are made."""
    whole = F.concat("record", F.lit(_EOL * 2))
    size = F.octet_length(whole).cast("long")
    return _with_starts(recs.select("file", "place", "id", size.alias("length"), F.sha2(whole, 256).alias("hash")))


def file_contents(recs: DataFrame, damage: Column | None = None) -> DataFrame:
    """``file``, ``content``, ``leaves``: the stored bytes of each file less the last one, which is 0, and the leaves of its records.

    Takes ``records`` in their order. ``damage`` is stored in place of the column ``record``; the leaves are those of
    the record. All of a row comes from one reading of ``recs``.
    """
    python_ready(recs.sparkSession)
    whole = F.concat("record", F.lit(_EOL * 2))
    kind = recs.schema["id"].dataType
    base = recs.select("file", "place", (F.col("record") if damage is None else damage).alias("stored"), "id",
                       F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("hash"))

    def work(batches):
        now, parts, leaves = None, [], []

        def done():
            rows = pa.concat_arrays(leaves)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([b"".join([*parts, _END[:-1]])], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["file", "content", "leaves"])

        for b in batches:
            rows = pa.StructArray.from_arrays([b.column(i) for i in (1, 3, 4, 5)], ["place", "id", "length", "hash"])
            for i, (file, place, record) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                if file != now:
                    if parts:
                        yield done()
                    now, parts, leaves = file, [], []
                if place != len(parts):
                    raise ValueError(f"file {file}: record {place} after {len(parts)} records")
                parts.append(gzip.compress(bytes(record.as_buffer() or b"") + _TAIL, 6, mtime=0))
                leaves.append(rows.slice(i, 1))
        if parts:
            yield done()

    return base.mapInArrow(work, "file bigint, content binary, leaves array<struct<place: int, "
                                 f"id: {kind.simpleString()}, length: bigint, hash: string>>")


def write_contents(contents: DataFrame, path: str) -> None:
    """One directory ``file=...`` with one file for each row; the text source's line end is the last byte."""
    (contents.select("file", F.col("content").cast("string").alias("value")).write
     .partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path))


def write_archive(recs: DataFrame, path: str) -> None:
    """One directory ``file=...`` for each file, its records one after the other."""
    write_contents(file_contents(recs), path)


_HEAD = re.compile(rb"WARC/1\.0\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d{1,18})\r\n(?:[^\r\n]+\r\n)*\r\n")


def split_records(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of each record; one whose stated length does not lead to a next record ends where that begins."""
    out, at, tail = [], 0, (_EOL * 2).encode()
    while at < len(data):
        m = _HEAD.match(data, at)
        end = m.end() + int(m[1]) + len(tail) if m else -1
        if data[end - len(tail):end] != tail or not (end == len(data) or data.startswith(b"WARC/1.0\r\n", end)):
            nxt = data.find(tail + b"WARC/1.0\r\n", at)
            end = nxt + len(tail) if nxt >= 0 else len(data)
        out.append((at, end - at))
        at = end
    return out


def _unpacked(data: memoryview, at: int):
    """(bytes, end) of the member that begins at ``at``; None if there is no whole one."""
    d, out = zlib.decompressobj(31), []
    try:
        while not d.eof and at < len(data):
            out.append(d.decompress(data[at:at + _CHUNK]))
            at += min(_CHUNK, len(data) - at)
    except zlib.error:
        return None
    return (b"".join(out), at - len(d.unused_data)) if d.eof else None


def members(data: bytes):
    """(bytes of the member or None, stored start, stored end), one after the other; None for a range that cannot be unpacked."""
    view, at = memoryview(data), 0
    while at < len(data):
        got = _unpacked(view, at)
        if got:
            yield got[0], at, got[1]
            at = got[1]
            continue
        end = data.find(_START[:3], at + 1)
        while end >= 0 and not (data.startswith(_START, end) or _unpacked(view, end)):
            end = data.find(_START[:3], end + 1)
        end = end if end >= 0 else len(data)
        yield None, at, end
        at = end


def stored_records(data: bytes):
    """(start, length, hash) of the records of a stored file."""
    found, start = [m for m in members(data) if m[0] != b""], 0
    for body, a, z in found:
        if body is None:
            yield start, z - a, hashlib.sha256(b"unreadable " + data[a:z]).hexdigest()
            start += z - a
            continue
        cuts = split_records(body)
        if len(found) > 1 and not all((m := _HEAD.match(body, x)) and m.end() + int(m[1]) + len(_TAIL) == x + n for x, n in cuts):
            cuts = [(0, len(body))]  # a member of its own is one record, whatever is in it
        for x, n in cuts:
            yield start + x, n, hashlib.sha256(memoryview(body)[x:x + n]).hexdigest()
        start += len(body)


def leaves_of_archive(spark, path: str) -> DataFrame:
    """``file``, ``place``, ``start``, ``length``, ``hash`` of an archive's records as they are stored."""
    python_ready(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
             .option("ignoreCorruptFiles", "true").load(path))
    number = F.regexp_extract("path", r"file=(-?\d+)", 1).try_cast("long")
    files = files.select(F.coalesce(number, F.xxhash64("path")).alias("file"), F.col("path").alias("name"), "content")

    def work(batches):
        for b in batches:
            for k, name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                start, length, digest = zip(*found, strict=True) if (found := list(stored_records(content.as_py()))) else ((), (), ())
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.int64()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.string())],
                    ["file", "name", "at", "start", "length", "hash"])

    out = files.mapInArrow(work, "file bigint, name string, at int, start bigint, length bigint, hash string")
    place = F.row_number().over(Window.partitionBy("file").orderBy("name", "at")) - 1
    return out.select("file", place.cast("int").alias("place"), "start", "length", "hash")


def tree(leaves: DataFrame, per_file: int) -> DataFrame:
    """``level``, ``file``, ``node``, ``hash``: level 0 the records, each level above hashes ``FANOUT`` children."""
    # the order is that of the offsets; the offsets themselves would carry one wrong length to all records after it
    leaf = F.sha2(F.concat_ws(" ", "length", "hash"), 256)
    level = leaves.select(F.lit(0).alias("level"), "file", F.col("place").cast("long").alias("node"), leaf.alias("hash"))
    out, width, n = level, per_file, 0
    while width > 1:
        n, width = n + 1, -(-width // FANOUT)
        kids = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])  # at most FANOUT
        level = (level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up"))
                 .agg(F.sha2(F.array_join(kids, ""), 256).alias("hash"))
                 .select(F.lit(n).alias("level"), "file", F.col("up").cast("long").alias("node"), "hash"))
        out = out.unionByName(level)
    return out


def mismatches(left: DataFrame, right: DataFrame, per_file: int) -> DataFrame:
    """``file``, ``place``: the records below nodes that differ, found level by level from the roots."""
    a, b = materialise(tree(left, per_file), "audit-left"), materialise(tree(right, per_file), "audit-right")
    top, width = 0, per_file
    while width > 1:
        top, width = top + 1, -(-width // FANOUT)
    open_nodes = None
    for n in range(top, -1, -1):
        x = a.filter(F.col("level") == n).select("file", "node", F.col("hash").alias("h1"))
        y = b.filter(F.col("level") == n).select("file", "node", F.col("hash").alias("h2"))
        if open_nodes is not None:  # descend only below the nodes that differ
            below = open_nodes.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            x, y = x.join(below, ["file", "node"], "left_semi"), y.join(below, ["file", "node"], "left_semi")
        both = x.join(y, ["file", "node"], "full_outer")
        open_nodes = materialise(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "node"), f"audit-open-{n}")
    return open_nodes.select("file", F.col("node").cast("int").alias("place"))


def compare(left: DataFrame, right: DataFrame, per_file: int = 512) -> DataFrame:
    """The leaves of ``left`` with ``intact``, and those that only ``right`` has, with their own range and hash, as not intact."""
    bad = mismatches(left, right, per_file)
    other = bad.join(right, ["file", "place"], "left").select("file", "place", *[F.col(c).alias(f"_{c}") for c in ("start", "length", "hash")],
                                                              F.lit(True).alias("bad"))
    out = left.join(other, ["file", "place"], "full_outer")
    surplus = F.col("hash").isNull()
    return out.select(*[F.when(surplus, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("start", "length", "hash") else F.col(c)
                        for c in left.columns], F.col("bad").isNull().alias("intact"))


def audit_replicas(spark, left: str, right: str, per_file: int = 512) -> DataFrame:
    """``compare`` of two stored archives, given by their paths."""
    return compare(materialise(leaves_of_archive(spark, left), "audit-one"),
                   materialise(leaves_of_archive(spark, right), "audit-other"), per_file)


def audit(pages: DataFrame, damage: Column | None = None, per_file: int = 512, **columns) -> DataFrame:
    """Write the pages as an archive, read it back and audit it against the pages.

    One row per record: ``file``, ``place``, ``id``, ``start``, ``length``, ``hash``, ``intact``. ``damage``: what a
    faulty store makes of the column ``record`` (default: nothing), to try the audit.
    """
    spark = pages.sparkSession
    recs = records(pages, per_file=per_file, **columns)
    path = shared_dir(spark, "warc")
    # once: another reading of the pages may number them otherwise. The archive and the source's leaves come from this table
    made = materialise(file_contents(recs, damage), "audit-made")
    write_contents(made, path)
    source = materialise(_with_starts(made.select("file", F.inline("leaves"))), "audit-source")
    stored = materialise(leaves_of_archive(spark, path), "audit-stored")
    return compare(source, stored, per_file).select("file", "place", "id", "start", "length", "hash", "intact")
