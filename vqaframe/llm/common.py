"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.session import shared_dir, ship_package

#: The white space of the text contracts: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """The package can be imported by the Python workers from here on."""
    ship_package(spark)


def packed(docs: DataFrame, **needed: str) -> DataFrame:
    """The whole input row as one struct column ``row``, and the needed columns under names of ours.

    Extra columns of the input therefore never clash with an operator's own columns.
    """
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       *[docs[f"`{c}`"].alias(name) for name, c in needed.items()])


def unpacked(df: DataFrame, columns: list[str], text_col: str = "text", text=None) -> DataFrame:
    """The input rows again; with ``text``, that column replaced and ``n_chars`` (if there) counted anew."""
    out = []
    for c in columns:
        col = F.col(f"row.`{c}`")
        if text is not None and c == text_col:
            col = text
        elif text is not None and c == "n_chars":
            col = F.char_length(text).cast("long")
        out.append(col.alias(c))
    return df.select(*out)
