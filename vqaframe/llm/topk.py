"""Exact top-k search by integer inner product.

Method: distributed histogram selection. Every query is scored against every row; the scores' global
histogram (counts by score range, summed over all tasks) locates the range that holds the k-th highest
score, the range is cut finer and the histogram taken anew, until the k-th value itself is known. A last
pass keeps the scores above it and, of those equal to it, the smallest ids.

Queries are taken in blocks of at most ``query_block`` rows; a block is what is broadcast and what the
driver holds, so both are bounded whatever the table. Rows are never shuffled: a task scores its rows in
chunks and sends, for each query, only the top histogram ranges that hold its k best scores (the k-th of
all rows is never below the k-th of one task), at most k rows. Ties are cut the same way before they move.

Vectors that are null or hold a null or non-finite component take no part. Only vectors of equal length
have a score. A row is no candidate for queries with its own id. Scores use 64-bit floats while they are
exact (below 2^53), else whole-number arithmetic, held within a signed long. A query id that repeats with
the same vector is answered once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.llm.common import materialise, python_ready

_CHUNK = 4_000_000  # scores at a time
_BITS = 8  # each round cuts a range into 256
_EXACT = float(2 ** 53)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    out = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{vector_col}`"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return out.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def _matrices(batch: pa.RecordBatch, scale: float):
    """(ids, floor(scale * x) as a matrix) for each vector length of a batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    at = np.r_[0, np.cumsum(sizes)]
    for d in np.unique(sizes):
        pick = np.flatnonzero(sizes == d)
        rows = flat[(at[pick][:, None] + np.arange(d)[None, :])] if d else np.zeros((len(pick), 0))
        yield ids[pick], np.floor(rows * scale)


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, queries by rows."""
    top = (np.abs(rows).max(initial=0.0) * np.abs(queries).max(initial=0.0)) * max(1, rows.shape[1])
    if top < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    exact = whole(queries).dot(whole(rows).T)
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


class _Block:
    """A bounded block of queries, by vector length, and for each the score range still searched."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], scale: float):
        self.ids, self.scale = ids, scale
        self.by_length = {}
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            pick = np.flatnonzero(sizes == d)
            whole = np.floor(np.stack([vectors[i] for i in pick]).reshape(len(pick), int(d)) * scale)
            self.by_length[int(d)] = (pick, whole)

    def parts(self, batch: pa.RecordBatch):
        """(query numbers, row ids, scores) in chunks; a query's own rows are marked by ``own``."""
        for ids, rows in _matrices(batch, self.scale):
            if rows.shape[1] not in self.by_length:
                continue
            pick, queries = self.by_length[rows.shape[1]]
            step = max(1, _CHUNK // max(1, len(pick)))
            for a in range(0, len(ids), step):
                part = ids[a:a + step]
                yield pick, part, _scores(rows[a:a + step], queries), part[None, :] == self.ids[pick][:, None]


def _distances(row: np.ndarray, floor: int) -> np.ndarray:
    """How far the scores that reach ``floor`` lie above it: unsigned, so that any two longs have a distance."""
    return row[row >= floor].astype(np.uint64) - np.array([floor], np.int64).astype(np.uint64)


def _histogram(rows: DataFrame, block, low, shift: int, k: int) -> DataFrame:
    """(q, bin, n): counts of each query's scores by (score - low[q]) >> shift, the bins that hold a task's k best."""

    def work(batches):
        b, floor = block.value, low.value
        have = [{} for _ in b.ids]
        for batch in batches:
            for pick, _, s, own in b.parts(batch):
                for j, q in enumerate(pick):
                    row = s[j][~own[j]]
                    if len(row) > k:  # what is below a chunk's k best lies below the k best of all rows
                        row = row[row >= np.partition(row, len(row) - k)[len(row) - k]]
                    # the k-th score lies in the first 2^_BITS ranges: what is beyond is only counted
                    at = np.minimum(_distances(row, floor[q]) >> np.uint64(shift), np.uint64(1 << _BITS))
                    for x, n in zip(*np.unique(at, return_counts=True), strict=True):
                        have[q][int(x)] = have[q].get(int(x), 0) + int(n)
        out = []
        for q, bins in enumerate(have):
            seen = 0
            for x in sorted(bins, reverse=True):
                out.append((q, x, bins[x]))
                seen += bins[x]
                if seen >= k:
                    break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["q", "bin", "n"])

    return rows.mapInArrow(work, "q bigint, bin bigint, n bigint")


def _best(rows: DataFrame, block, kth, k: int) -> DataFrame:
    """(q, query_id, id, score): each task's scores above the k-th value, and of those equal to it the k smallest ids."""

    def work(batches):
        b, floor = block.value, kth.value
        have = [[] for _ in b.ids]
        for batch in batches:
            for pick, ids, s, own in b.parts(batch):
                hit = (s >= floor[pick][:, None]) & ~own
                for j in np.flatnonzero(hit.any(axis=1)):
                    q, at = pick[j], np.flatnonzero(hit[j])
                    got = [*have[q], *zip((-s[j][at]).tolist(), ids[at].tolist(), strict=True)]
                    have[q] = sorted(got)[:k]  # by falling score, then id
        out = [(q, int(b.ids[q]), i, -s) for q, found in enumerate(have) for s, i in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             ["q", "query_id", "id", "score"])

    return rows.mapInArrow(work, "q bigint, query_id bigint, id bigint, score bigint")


def _search_block(spark, rows: DataFrame, ids, vectors, k: int, scale: float, norm: float) -> DataFrame:
    """query_id, rank, id, score for one block of queries."""
    block = spark.sparkContext.broadcast(_Block(ids, vectors, scale))
    most = max(float(np.linalg.norm(m, axis=1).max(initial=0.0)) for _, m in block.value.by_length.values())
    bound = min(2 ** 63 - 1, int(math.ceil(most * norm)) + 1)  # no score is larger, by Cauchy and Schwarz
    low = np.full(len(ids), -bound - 1, np.int64)
    bits = (2 * bound + 1).bit_length()
    while bits > 0:
        shift = max(0, bits - _BITS)
        counts = _histogram(rows, block, spark.sparkContext.broadcast(low), shift, k).groupBy("q", "bin").agg(F.sum("n").alias("n"))
        seen = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()))
        # the highest range with k scores in it and above; the lowest one where there are fewer than k
        found = counts.withColumn("seen", seen).groupBy("q").agg(
            F.coalesce(F.max(F.when(F.col("seen") >= k, F.col("bin"))), F.min("bin")).alias("bin")).collect()
        low = low.copy()
        for r in found:  # one row per query of the block
            low[r["q"]] = int(low[r["q"]]) + (r["bin"] << shift)
        bits = shift
    best = _best(rows, block, spark.sparkContext.broadcast(low), k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 1024.0, query_block: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``: the k highest scores of every query row.

    ``is_query``: a condition on the column ``id``. A query id with several vectors is answered for the smallest.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    rows = usable_vectors(vectors, id_col, vector_col)
    queries = materialise(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    # whole-number components differ from the scaled ones by less than 1
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, 2))))).first()[0]
    out, last = None, None
    while True:
        page = queries if last is None else queries.filter(F.col("id") > last)
        got = page.orderBy("id").limit(query_block).collect()  # at most query_block rows
        if not got:
            break
        last = got[-1]["id"]
        part = _search_block(spark, rows, np.array([r["id"] for r in got], np.int64),
                             [np.array(r["v"], np.float64) for r in got], k, scale, norm)
        part = materialise(part, "topk-block")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.col("id").alias("score")).limit(0)
    return out
