"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in few bits.

Method: deletion-variant signatures. With at most 4 differing bits and three segments (22, 21 and 21
bits), one segment differs in at most one bit. Each segment is indexed under its one-wildcard variants
(bit i masked, for every i): two segments that differ in at most one bit share a variant. An equality
grouping by variant brings candidates together, and whole fingerprints verify them by bit distance.

Documents with equal fingerprints are one node, so exact copies cost nothing further. Inside a variant's
bucket no pairs are written: a search from each unvisited fingerprint emits one link for every newly
reached one, so a bucket of n gives at most n - 1 links which connect all that its pairs would. A bucket of more than ``block`` fingerprints is
cut into blocks and dealt as pairs of blocks to many tasks: no cap, no skipped candidate. Components of
the links come from alternating large-star and small-star steps, each round written to the shared folder.

Defined results: a null or empty text has no shingles and fingerprint zero, linked like any other;
repeated rows share a fingerprint and so a component; null ids never name a component unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.llm.common import materialise, packed, python_ready, unpacked


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()  # bytes: only A-Z change, only the blanks of the contract split
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], np.uint64)
    bits = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        part = h[a:a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> list:
    row = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    return [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(1), *row).alias("k2")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """One row per document: ``id``, ``k1`` and ``k2`` (hashes of id and text), ``fp`` (64 bits as a signed long)."""
    python_ready(docs.sparkSession)
    base = docs.select(docs[f"`{id_col}`"].alias("id"), *row_keys(docs, id_col, text_col),
                       F.encode(F.coalesce(docs[f"`{text_col}`"], F.lit("")), "UTF-8").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(3).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], ["id", "k1", "k2", "fp"])

    return base.mapInArrow(work, f"id {id_type}, k1 bigint, k2 bigint, fp bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs in at most one bit."""
    n = max_bits // 2 + 1
    edges = [-(-64 * k // n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): every one-wildcard variant of every segment. A key holds segment, wildcard bit and the masked bits."""
    keys = []
    for k, (first, width) in enumerate(segments(max_bits)):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            masked = part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            tag = k * 64 + bit
            # the wildcard bit is zero, so dropping it leaves a number of width - 1 bits
            low = masked.bitwiseAND(F.lit((1 << bit) - 1))
            high = F.shiftleft(F.shiftright(masked, bit + 1), bit)
            keys.append(F.lit(tag).cast("long") * F.lit(1 << 40) + (high + low))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _bucket_links(fp: np.ndarray, left: np.ndarray | None, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all pairs within max_bits. left: where given, only pairs across the two sides count."""
    out = []
    if left is None:
        todo = np.arange(len(fp))
        while len(todo):
            queue, todo = [todo[0]], todo[1:]
            while queue and len(todo):
                i = queue.pop()
                near = _distance(fp[todo], fp[i]) <= max_bits
                if near.any():
                    found = todo[near]
                    out.append((np.full(len(found), fp[i]), fp[found]))
                    queue.extend(found)
                    todo = todo[~near]
        return out
    sides = [np.flatnonzero(left), np.flatnonzero(~left)]
    while len(sides[0]) and len(sides[1]):
        queue, sides[0] = [(int(sides[0][0]), 0)], sides[0][1:]
        while queue:
            i, side = queue.pop()
            other = sides[1 - side]
            near = _distance(fp[other], fp[i]) <= max_bits
            if near.any():
                found = other[near]
                out.append((np.full(len(found), fp[i]), fp[found]))
                queue.extend((int(x), 1 - side) for x in found)
                sides[1 - side] = other[~near]
    return out


def links(nodes: DataFrame, max_bits: int = 4, block: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs of at most ``max_bits`` differing bits."""
    spark = nodes.sparkSession
    python_ready(spark)
    # a small table that grows 64-fold: dealt out first, in a count that is not merged again
    index = variants(nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp"), max_bits)
    large = (index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
             .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    large = materialise(large, "simhash-large")
    joined = index.join(large, "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")
    dealt = joined.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                         "fp", "own")

    def work(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, lo, hi, own = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own"))
        fp = t.column("fp").to_numpy().view(np.uint64)
        del t, got
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        group = np.repeat(np.arange(len(starts)), sizes)
        one_side = lo == hi
        a, b = [], []
        few = (sizes <= 8)[group] & one_side
        for d in range(1, 8):  # small buckets, all at once
            if len(fp) <= d:
                break
            ok = few[d:] & (group[d:] == group[:-d]) & (_distance(fp[d:], fp[:-d]) <= max_bits)
            a.append(fp[:-d][ok])
            b.append(fp[d:][ok])
        for s, n in zip(starts, sizes, strict=True):
            if n > 8 or (n > 1 and not one_side[s]):
                left = None if one_side[s] else own[s:s + n] == lo[s]
                for x, y in _bucket_links(fp[s:s + n], left, max_bits):
                    a.append(x)
                    b.append(y)
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0).view(np.int64)
            for k in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[k:k + 100_000, c])) for c in (0, 1)], ["a", "b"])

    near = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(work, "a bigint, b bigint")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node and the smallest node reachable from it.

    Alternating large-star and small-star until nothing changes; a node's smallest neighbour is an
    aggregate with map-side combining, and hot nodes are split by the skew join.
    """
    edges = materialise(edges.filter(F.col("a") != F.col("b")), "components-0")
    step, before = 0, None
    while True:
        for large in (True, False):
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if large:
                both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            else:  # each edge at its larger end
                both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            least = materialise(least, "components-least")  # so that the join shuffles both sides and can split a hub
            joined = both.join(least, "u")
            if large:
                out = joined.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
            else:
                out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
                    least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            edges = out.filter(F.col("a") != F.col("b")).distinct()
            edges = materialise(edges, f"components-{step}")
        step += 1
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, seed: int = 42, block: int = 4096) -> DataFrame:
    """One row per document: ``id``, ``k1``, ``k2``, ``fp``, ``component_id`` (smallest id reachable over links, itself included)."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-nodes")
    comp = components(links(nodes.select("fp"), max_bits, block))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-ids")
    named = rooted.join(ids, "root").select(F.col("fp").alias("named_fp"), "root", "component_id")
    named = materialise(named, "simhash-named")
    return prints.join(named, prints["fp"] == named["named_fp"]).select("id", "k1", "k2", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id, whole rows."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stay = materialise(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("x"))
                       .select("x.k1", "x.k2"), "simhash-stay")
    base = packed(docs, id=id_col, text=text_col)
    base = base.select("row", *row_keys(base, "id", "text"))
    # the same id and text may come several times: the first of them
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1", "k2"))
    return unpacked(base.join(stay, ["k1", "k2"]).withColumn("nth", nth).filter("nth = 1"), docs.columns)
