"""Saving, loading and load-or-build of prepared datasets; log sink."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.session import path_exists


def save_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> None:
    """Write Parquet from the executors (never through the driver)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S3: read a saved dataset back."""
    return spark.read.parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  load: bool = True, partition_by: list[str] | None = None) -> DataFrame:
    """Reuse the saved dataset when asked and complete, else build and save.

    Complete is a folder with the success marker that Spark's writer leaves after its commit.
    Both branches return the table read back from storage, so a sampled
    dataset is frozen once written.
    """
    if not (load and path_exists(spark, f"{path}/_SUCCESS")):
        save_dataset(build(), path, partition_by)
    return load_dataset(spark, path)


def write_log(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Log records as JSON lines; absent (null) fields are omitted.

    ``records`` is a frame with a column per field, or one VARIANT column ``record``, whose records each have
    their own fields and types.
    """
    if records.columns == ["record"] and records.schema["record"].dataType.simpleString() == "variant":
        lines = records.select(F.to_json("record").alias("value"))
    else:
        lines = records.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("value"))
    lines.write.mode(mode).text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log as a VARIANT column ``record``; a line that is no JSON fails the read."""
    return spark.read.text(path).select(F.parse_json("value").alias("record"))


def log_field(name: str, kind: str, record: str = "record"):
    """A field of a log record by its path (``a.b`` goes into nested ones); null where absent or of another kind."""
    return F.try_variant_get(F.col(record), f"$.{name}", kind)


def log_frame(spark: SparkSession, history: list[dict]) -> DataFrame:
    """A ragged list of log dicts (driver-sized input) as records, whatever their fields hold; nulls are absent."""
    texts = [(json.dumps({k: v for k, v in rec.items() if v is not None}),) for rec in history]
    return spark.createDataFrame(texts, "value string").select(F.parse_json("value").alias("record"))
