"""Seeded shuffle and exact-size samples (L1-L3) without a global sort.

Order = (md5(key ':' seed), key). A sample of k rows is the first k rows of
that order. Selection uses hash-prefix histograms: every prefix of 2 hex
characters is a bucket (256 per level, the only data that reaches the
driver). The bucket holding the k-th row is refined with the next 2 digits
until it is small; only that bucket is ordered, to read the
k-th (hash, key) pair. The sample is then one filter over the input,
``(hash, key) <= threshold``: it equals ``ORDER BY h, key LIMIT k``, does not
depend on the partitioning, and scans its input once when used.

``shuffled`` gives every row its place in that order: ranges of the hash (prefixes, refined by the same
histograms until each is small), prefix sums over their counts, and a rank inside each range.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.operators.rowindex import with_row_index
from vqaframe.session import literal_frame, reliable_checkpoint

HASH_COL = "_shuffle_h"
# 2 hex digits = 256 buckets per level: each map task sends at most 256
# partial counts, so the histogram shuffle stays small with 100k+ tasks;
# 10^12 rows need 3 levels to reach a cut bucket under 1M rows.
_DIGITS_PER_LEVEL = 2
_HASH_LEN = 32


_NULL_KEY = "\u0000null"  # a null key's place in the hashed text


def shuffle_key(key_cols: list[str], seed: int = 42):
    """md5 hex of the key text and the seed: a seeded, repeatable shuffle order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL_KEY)) for c in key_cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws("\u001f", *parts)
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def seeded_shuffle(df: DataFrame, key_cols: list[str], seed: int = 42) -> DataFrame:
    """The rows with their shuffle hash; ordering happens only where needed."""
    return df.withColumn(HASH_COL, shuffle_key(key_cols, seed))


_RANGE_DIGITS = 3  # 4096 ranges a level; the first level is enough for 4 * 10^9 rows


def _hash_ranges(hashes: DataFrame, small: int):
    """Prefixes of the hash that hold at most ``small`` rows each, or one hash only.

    Returns (sorted (prefix, rows, one hash) of all ranges, the refined prefixes of each level). The driver
    sees 4096 counts for the first level and for every range over ``small``, of which there are at most n / small.
    """
    ranges, refined, pending = [], [], [""]
    while pending:
        size = _RANGE_DIGITS * len(refined)
        scope = hashes
        if size:
            heavy = F.broadcast(literal_frame(hashes.sparkSession, [(p,) for p in pending], [("_heavy", "string")]))
            scope = hashes.join(heavy, F.substring(HASH_COL, 1, size) == F.col("_heavy"))
        counts = (scope.groupBy(F.substring(HASH_COL, 1, size + _RANGE_DIGITS).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n"), (F.min(HASH_COL) == F.max(HASH_COL)).alias("one")).collect())
        refined.append(pending)
        pending = [r["p"] for r in counts if r["n"] > small and not r["one"]]
        again = set(pending)
        ranges += [(r["p"], r["n"], r["one"]) for r in counts if r["p"] not in again]
    return sorted(ranges), refined[1:]


def shuffled(df: DataFrame, key_cols: list[str], seed: int = 42, pos_col: str = "position",
             small: int = 1_000_000, hashes: DataFrame | None = None) -> DataFrame:
    """L1: every row with its 0-based place in the seeded shuffle, ``row_number() over (order by hash, key) - 1``.

    The hashes are pinned once, so the counts don't run ``df`` again; the rows themselves move once, to their
    range. Rows of equal keys are ordered by a hash of the whole row; if one key has more than ``small`` rows, those
    get their places from a row index instead of one task (in any order: the key says nothing about it).
    ``hashes``: the pinned hashes of the rows, or of more rows of which ``df`` holds the first.
    """
    spark = df.sparkSession
    if hashes is None:
        hashes = reliable_checkpoint(df.select(shuffle_key(key_cols, seed).alias(HASH_COL)))
    ranges, refined = _hash_ranges(hashes, small)
    starts = [0, *accumulate(n for _, n, _ in ranges)]
    place = F.substring(HASH_COL, 1, _RANGE_DIGITS)
    rows = df.withColumn(HASH_COL, shuffle_key(key_cols, seed)).withColumn("_range", place)
    for level, prefixes in enumerate(refined, 1):
        heavy = F.broadcast(literal_frame(spark, [(p,) for p in prefixes], [("_heavy", "string")]))
        rows = (rows.join(heavy, F.substring(HASH_COL, 1, _RANGE_DIGITS * level) == F.col("_heavy"), "left")
                .withColumn("_range", F.when(F.col("_heavy").isNotNull(), F.substring(HASH_COL, 1, _RANGE_DIGITS * (level + 1)))
                            .otherwise(F.col("_range"))).drop("_heavy"))
    table = spark.createDataFrame(pa.table({
        "_p": pa.array([p for p, _, _ in ranges], pa.string()), "_first": pa.array(starts[:len(ranges)], pa.int64()),
        "_one": pa.array([one and n > small for _, n, one in ranges], pa.bool_())}))
    rows = rows.join(F.broadcast(table), F.col("_range") == F.col("_p"))
    order = [F.col(HASH_COL), *[F.col(c) for c in key_cols], F.xxhash64(*df.columns)]
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    out = rows.filter(~F.col("_one")).withColumn(pos_col, F.col("_first") + rank)
    for (prefix, n, one), start in zip(ranges, starts):
        if one and n > small:
            same = rows.filter(F.col("_range") == prefix).withColumn("_any", F.monotonically_increasing_id())
            out = out.unionByName(with_row_index(same, [F.col("_any")], "_nth").withColumn(
                pos_col, F.lit(start) + F.col("_nth")).drop("_any", "_nth"))
    return out.select(*df.columns, pos_col)


def sample_size(n: int, fraction: float) -> int:
    """``int(p * n)`` in double arithmetic, as the reference computes it."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be within [0, 1], got {fraction}")
    return int(fraction * n)


def exact_sample(df: DataFrame, key_cols: list[str], fraction: float | None = None,
                 k: int | None = None, cap: int | None = None, seed: int = 42,
                 small_cut: int = 1_000_000, with_count: bool = False, pin_keys: bool = False,
                 position_col: str | None = None):
    """First ``k`` rows of the seeded shuffle, exactly.

    Give ``fraction`` (L2: k = int(fraction * n)), ``k``, or ``cap``
    (L3: k = min(cap, n)). Keys should be unique; duplicate keys are ordered
    by a hash of the whole row so the choice stays deterministic.
    Returns the sample, or (sample, n, k) when ``with_count``. ``pin_keys``: write the keys and their
    hashes once for the passes that find the threshold (for a ``df`` that is costly to run, such as a join).
    ``position_col``: every row's place in the shuffle, from 0 (see ``shuffled``).
    """

    def done(out, k):
        if position_col:
            pinned = hashed.select(HASH_COL) if pin_keys else None
            out = shuffled(out, key_cols, seed, position_col, small_cut, pinned)
        return (out, n, k) if with_count else out

    hashed = seeded_shuffle(df, key_cols, seed)
    rows = hashed
    if pin_keys:
        hashed = reliable_checkpoint(hashed.select(*key_cols, HASH_COL))
    prefix = ""
    n = None
    need = None  # rows still to take inside the current prefix
    cut_count = None
    while True:
        start = len(prefix) + 1
        scope = hashed if not prefix else hashed.filter(F.col(HASH_COL).startswith(prefix))
        hist = (scope.groupBy(F.substring(HASH_COL, start, _DIGITS_PER_LEVEL).alias("b"))
                .agg(F.count(F.lit(1)).alias("c"),
                     (F.min(HASH_COL) == F.max(HASH_COL)).alias("single")).collect())
        single = {r["b"]: r["single"] for r in hist}
        hist = sorted((r["b"], r["c"]) for r in hist)
        if n is None:
            n = sum(c for _, c in hist)
            if fraction is not None:
                need = sample_size(n, fraction)
            elif k is not None:
                need = min(k, n)
            elif cap is not None:
                need = min(cap, n)
            else:
                raise ValueError("give fraction, k or cap")
            total_k = need
            if need == 0:
                return done(df.limit(0), 0)
            if need == n:
                return done(df, n)
        run = 0
        cut_single = False
        for b, c in hist:
            if run + c >= need:
                prefix += b
                need -= run
                cut_count = c
                cut_single = single[b]
                break
            run += c
        # stop when the cut bucket is small, or holds one hash value only
        # (duplicates of one key: more digits cannot split it)
        if cut_count <= small_cut or cut_single or len(prefix) >= _HASH_LEN:
            break
    cut = hashed.filter(F.col(HASH_COL).startswith(prefix))
    tie = F.xxhash64(*df.columns)
    order = [F.col(HASH_COL)] + [F.col(c) for c in key_cols] + [tie]
    if cut_count <= small_cut:
        # the need-th row of the cut bucket is the threshold; one more row
        # shows whether a tie crosses it. Key columns only: the scan is pruned.
        key_order = order[:-1]
        on_df = [shuffle_key(key_cols, seed)] + [F.col(c) for c in key_cols]
        edge = cut.select(*key_order).orderBy(*key_order).offset(need - 1).limit(2).collect()
        if len(edge) == 1 or tuple(edge[0]) != tuple(edge[1]):
            return done(df.filter(_at_most(on_df, tuple(edge[0]))), total_k)
        # duplicate keys at the threshold: the whole-row hash decides
        cut = rows.filter(F.col(HASH_COL).startswith(prefix))
        edge = cut.select(*order).orderBy(*order).offset(need - 1).limit(2).collect()
        if tuple(edge[0]) != tuple(edge[1]):
            return done(df.filter(_at_most(on_df + [tie], tuple(edge[0]))), total_k)
    # whole-row ties across the threshold (duplicate rows): rank them exactly
    before = rows.filter(F.col(HASH_COL) < F.lit(prefix))
    cut = rows.filter(F.col(HASH_COL).startswith(prefix))
    ranked = with_row_index(cut.withColumn("_tie", tie),
                            [F.col(HASH_COL)] + [F.col(c) for c in key_cols] + [F.col("_tie")],
                            "_rank")
    top = ranked.filter(F.col("_rank") < need).drop("_tie", "_rank")
    return done(before.unionByName(top).drop(HASH_COL), total_k)


def _at_most(order: list, values: tuple):
    """Lexicographic ``tuple(order) <= values``, written so that later columns
    (the whole-row tie hash) are evaluated only when earlier ones are equal."""
    cond = F.lit(True)
    for c, v in zip(reversed(order), reversed(values)):
        # nulls come first, as in orderBy
        below = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
        cond = below | (c.eqNullSafe(F.lit(v)) & cond)
    return cond
