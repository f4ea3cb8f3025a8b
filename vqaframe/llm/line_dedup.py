"""Line dedup: drop lines that many documents share (native: DataFrame functions only).

Method: explode the normalised lines, hash them, count the documents of each hash, drop the lines of
hashes over the threshold, and reassemble the rest by position.

A line's key is the line stripped of blanks (space, U+0009 to U+000D) with A-Z lower-cased. Keys are
compared by two independent 64-bit hashes. Only hashes move for the counts: each document sends every
key once, counts are combined before the shuffle, so a line in a third of all documents costs one row
a task. The hashes to drop are written to the shared folder and joined with the exploded positions (a
plain join of two shuffles, which Spark splits when one hash is hot). Dropped positions return to the
documents by (id, text hash); no line text is shuffled for the counts.

Defined results: a null or empty text is one empty line; each input row is one document, also where
ids repeat; rows that tie on the largest id all keep the line; a null id counts as smaller than any
other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import BLANK, LOWER, UPPER, materialise, packed


def line_keys(text: Column) -> Column:
    """Array of the lines' keys, by position."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1),
                       lambda line: F.btrim(line, F.lit(BLANK)))


def _hashes(keys: Column, min_chars: int) -> Column:
    """(position, two hashes) of the keys that are long enough."""
    marked = F.transform(keys, lambda k, i: F.struct(
        i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"),
        F.char_length(k).alias("n")))
    return F.filter(marked, lambda x: x["n"] >= min_chars)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document: ``row`` (the input), ``id``, ``n_lines``, ``n_dropped``, ``kept_text``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
    lines except in the document with the largest id that holds them.
    """
    base = packed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    hashed = base.select("id", F.xxhash64("text").alias("version"),
                         _hashes(line_keys(F.col("text")), min_chars).alias("lines"))

    # each document sends a hash once
    once = hashed.select("id", F.explode(F.array_distinct(F.transform(
        "lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("h"))
    common = (once.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner"))
              .filter(F.col("n") >= min_docs).select("h1", "h2", "owner"))
    common = materialise(common, "line-dedup-common")

    lines = hashed.select("id", "version", F.explode("lines").alias("x")).select(
        "id", "version", F.col("x.pos").alias("pos"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    gone = (lines.join(common, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("owner")))
            .groupBy(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"))
            .agg(F.collect_set("pos").alias("gone")))  # at most the lines of one document

    rows = base.withColumn("version", F.xxhash64("text")).drop("text")  # the text moves once, inside the row
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["gone_id"]) &
                       (rows["version"] == gone["gone_version"]), "left")
    joined = joined.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    split = joined.select("row", "id", "text", F.split("text", "\n", -1).alias("all_lines"),
                          "gone")
    n_lines = F.size("all_lines")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    return split.select(
        "row", "id", n_lines.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get(F.col("all_lines"), i)), "\n")).alias("kept_text"))
