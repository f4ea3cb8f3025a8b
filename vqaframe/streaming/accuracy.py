"""Incremental accuracy over metric lines as they arrive.

A file stream over the S7 layout parses each new line (S8 rules), keeps one
state row per rank (sum, count), and publishes the complete per-rank table
plus the overall mean after every micro-batch. No watermark is needed: the
state is bounded by the number of ranks. The checkpoint makes the running
sums exactly-once across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.functions.parse import python_float


def metric_line_stream(spark: SparkSession, directory: str, clean_source: str | None = None,
                       archive_dir: str | None = None) -> DataFrame:
    """Streaming (rank, line, value) over ``directory/rank=<r>/`` text files.

    ``clean_source='archive'|'delete'`` gives S9's consume-once behaviour.
    """
    r = spark.readStream.format("text").schema("value string, rank int")
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if archive_dir:
            r = r.option("sourceArchiveDir", archive_dir)
    raw = r.load(directory)
    return raw.select("rank", F.col("value").alias("line"), python_float("value").alias("value"))


def running_accuracy(lines: DataFrame) -> DataFrame:
    """Per-rank running sum and count of parseable values."""
    v = lines.filter(F.col("value").isNotNull())
    return v.groupBy("rank").agg(F.sum("value").alias("sum_value"),
                                 F.count("value").alias("n_values"))


def run_incremental_accuracy(spark: SparkSession, directory: str, checkpoint: str,
                             out_path: str, available_now: bool = True,
                             clean_source: str | None = None, archive_dir: str | None = None,
                             state_partitions: int = 4):
    """Run X1 and keep ``out_path`` holding the latest complete per-rank table.

    Each micro-batch overwrites ``out_path`` with (rank, n_values, sum_value,
    mean_value); the overall mean is ``sum(sum_value) / sum(n_values)`` over it.
    The state has one row per rank, so it is kept in ``state_partitions``
    partitions (Spark fixes this number in the checkpoint on first start)
    instead of one per shuffle partition of the session.
    Returns the finished (availableNow) or running query handle.
    """
    agg = running_accuracy(metric_line_stream(spark, directory, clean_source, archive_dir))

    def publish(batch: DataFrame, _epoch: int) -> None:
        (batch.select("rank", "n_values", "sum_value",
                      (F.col("sum_value") / F.col("n_values")).alias("mean_value"))
         .write.mode("overwrite").parquet(out_path))

    w = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(publish))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    key = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        q = w.start()
    finally:
        spark.conf.set(key, previous)
    if available_now:
        q.awaitTermination()
    return q


def overall_mean(per_rank: DataFrame) -> DataFrame:
    """A3 across ranks from the per-rank state: 0.0 when nothing parsed."""
    return per_rank.agg(F.coalesce(F.sum("sum_value") / F.sum("n_values"), F.lit(0.0))
                        .alias("mean_accuracy"), F.sum("n_values").alias("n_values"))
