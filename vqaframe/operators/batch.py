"""Batch numbering, batch assembly and collation.

A batch is at most ``batch_size`` rows, so every group here is bounded by
construction; no group can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.operators.encode import field_of
from vqaframe.operators.rowindex import with_row_index


def assign_batches(df: DataFrame, batch_size: int, order_cols: list | None = None,
                   dense_id: str | None = None, batch_col: str = "batch_id",
                   pos_col: str = "batch_pos", key_cols: list[str] | None = None) -> DataFrame:
    """Batch number and position inside the batch, in dataset order.

    With a dense 0-based id column the batch is ``id div batch_size`` (no
    shuffle). Otherwise a global row index is built from ``order_cols``
    (range sort + per-partition offsets). With ``key_cols`` (a unique key
    that contains the order columns) only the keys are indexed and pinned,
    and the numbers are joined back. The payload (texts, logits) then moves
    once, through an ordinary shuffle join, and is never written to the
    checkpoint.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if dense_id is not None:
        idx = F.col(dense_id)
        out = df
    elif key_cols:
        numbered = with_row_index(df.select(*key_cols), order_cols, "_row")
        out = df.join(numbered, list(key_cols), "inner")
        idx = F.col("_row")
    else:
        out = with_row_index(df, order_cols, "_row")
        idx = F.col("_row")
    out = out.withColumns({batch_col: F.floor(idx / batch_size).cast("long"),
                           pos_col: (idx % batch_size).cast("int")})
    return out.drop("_row") if dense_id is None else out


def assemble_batches(df: DataFrame, fields: list[str], batch_col: str = "batch_id",
                     pos_col: str = "batch_pos") -> DataFrame:
    """One row per batch, each field concatenated in position order."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("_p"), *fields)))
    g = df.groupBy(batch_col).agg(packed.alias("_s"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(batch_col, "n_rows",
                    *[F.transform("_s", field_of(f)).alias(f) for f in fields])


def collate(encoded: DataFrame, fields: list[str], batch_size: int, position_col: str,
            keys: list[str] | None = None) -> DataFrame:
    """Encoded examples (one row with an array per field) -> batches of ``batch_size`` examples.

    ``position_col`` is the examples' dense 0-based order, such as the place in the seeded shuffle. One shuffle by
    batch: one row per batch with one array<array<...>> per field and one array per key, examples in order.
    """
    numbered = assign_batches(encoded, batch_size, dense_id=position_col)
    return assemble_batches(numbered, [*(keys or []), *fields])
