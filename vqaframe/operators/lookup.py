"""Lookups inside the row (J3, G4): a bounded table as one array, found by a hash slot.

``in_row_table`` turns a table of (key, value) into an array of slots, each with the few entries whose key hashes
there. It is a scalar subquery: run once, sent with the plan. Every element of an array column is mapped through
it inside ``transform``: no explosion, no join, no shuffle, and the order of the elements stays.

A table is measured first (rows and bytes). One that is too large is never sent: ``look_up`` then joins the
distinct elements of every row with the table (a plain shuffle join; Spark splits hot elements), and each row
looks its elements up in the small table that comes back for it. Positions are not shuffled in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds for a table that is sent with the plan: rows, and bytes of text plus
# a per-row overhead for the other column and the array slot.
MAX_ROWS = 1_000_000
MAX_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD_BYTES = 32


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of string data) of ``df`` in one aggregation job.

    The result is remembered on the DataFrame object: a vocabulary is a
    pinned (checkpointed) table, so its size cannot change afterwards.
    """
    known = getattr(df, "_vqaframe_size", None)
    if known is not None:
        return known
    strings = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema.fields
               if f.dataType.simpleString() == "string"]
    text_bytes = sum(strings[1:], strings[0]) if strings else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), text_bytes.alias("b")).first()
    size = (int(row["n"]), int(row["b"] or 0))
    df._vqaframe_size = size
    return size


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether ``df`` is within ``max_rows`` rows and ``max_bytes`` of string
    data plus a fixed per-row overhead."""
    n, b = measure(df)
    return n <= max_rows and b + n * ROW_OVERHEAD_BYTES <= max_bytes


def _slot(key, slots) -> Column:
    return F.pmod(F.xxhash64(key), slots).cast("int")


def in_row_table(table: DataFrame, key: str, value: str) -> tuple[Column, int]:
    """(array of slots as a scalar subquery, number of slots) of a table whose size was checked."""
    slots = max(1, measure(table)[0])  # about one entry each
    entries = (table.filter(F.col(key).isNotNull())
               .groupBy(_slot(F.col(key), F.lit(slots)).alias("slot"))
               .agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("entries")))
    every = table.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    none = F.array().cast(entries.schema["entries"].dataType)
    full = every.join(entries, "slot", "left").select("slot", F.coalesce("entries", none).alias("entries"))
    packed = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "entries"))), lambda x: x["entries"]))
    return packed.scalar(), slots


def _find(bucket: Column, key, default: Column) -> Column:
    hit = F.filter(bucket, lambda x: x["key"] == key)
    return F.coalesce(F.get(hit, F.lit(0))["value"], default)


def look_up(df: DataFrame, keys: list[str], columns: dict[str, Column], table: DataFrame, key: str, value: str,
            default: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` with an array column of values for each array of elements in ``columns`` (name -> elements).

    Elements that the table lacks, and null ones, get ``default``; a null array stays null. ``keys`` are only
    used beyond the bound, where they must name a row.
    """
    if fits(table, max_rows):
        array, slots = in_row_table(table, key, value)

        def mapped(elements, i):
            # a subquery cannot stand in a higher-order function, but a column can, and the optimizer puts the
            # subquery in its place (each is used once): the table is no part of any row. As an argument of
            # the outer transform it is taken once per row
            found = F.transform(F.array(f"_table{i}"), lambda t: F.transform(
                elements, lambda w: _find(F.get(t, _slot(w, F.lit(slots))), w, default)))
            return F.get(found, F.lit(0))

        tables = df.select("*", *[array.alias(f"_table{i}") for i in range(len(columns))])
        return tables.select(*df.columns, *[mapped(c, i).alias(name) for i, (name, c) in enumerate(columns.items())])
    named = {f"_e{i}": c for i, c in enumerate(columns.values())}
    df = df.withColumns(named)
    none = F.array().cast(df.schema["_e0"].dataType)
    words = F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in named]))
    asked = df.select(*keys, F.size(words).alias("_n"), F.explode(words).alias("_w"))
    known = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    # about eight entries a slot
    slots = F.greatest(F.lit(1), F.floor(F.max("_n") / 8)).cast("int")
    small = (asked.join(known, F.col("_w") == F.col("_key")).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
             .agg(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_value").alias("value"))).alias("_found"),
                  slots.alias("_slots")))  # the distinct elements of one row
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(small, same, "left")
    table_of_row = F.transform(F.sequence(F.lit(0), F.col("_slots") - 1),
                               lambda s: F.filter("_found", lambda x: _slot(x["key"], F.col("_slots")) == s))
    joined = joined.withColumn("_table", F.when(F.col("_slots").isNotNull(), table_of_row))
    out = {name: F.transform(F.col(c), lambda w: _find(F.get(F.col("_table"), _slot(w, F.col("_slots"))), w, default))
           for name, c in zip(columns, named, strict=True)}
    return joined.withColumns(out).drop(*named, *[f"_k{i}" for i in range(len(keys))], "_found", "_slots", "_table")


