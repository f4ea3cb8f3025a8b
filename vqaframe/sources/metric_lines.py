"""Per-rank metric line files.

Layout: ``<dir>/rank=<r>/part-*.txt``, one value per line, appended per
evaluation batch. Reading parses every line with Python's float rules and
skips the rest.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.functions.parse import python_float
from vqaframe.session import shared_dir


def append_metric_lines(values: DataFrame, directory: str, value_col: str = "value",
                        rank_col: str = "rank") -> None:
    """Append each value as a text line under its rank's folder."""
    (values.select(F.col(rank_col).alias("rank"), F.col(value_col).cast("string").alias("value"))
     .write.mode("append").partitionBy("rank").text(directory))


def read_metric_lines(spark: SparkSession, directory: str) -> DataFrame:
    """(rank, line, value); value is null where ``float()`` would raise."""
    raw = spark.read.text(directory)
    return raw.select("rank", F.col("value").alias("line"), python_float("value").alias("value"))


def mean_of_lines(lines: DataFrame, by_rank: bool = False) -> DataFrame:
    """A3 over parsed lines: sum / count of parseable values, 0.0 when none."""
    v = lines.filter(F.col("value").isNotNull())
    agg = [F.count("value").alias("n_values"), F.sum("value").alias("sum_value"),
           F.coalesce(F.sum("value") / F.count("value"), F.lit(0.0)).alias("mean_value")]
    return v.groupBy("rank").agg(*agg) if by_rank else v.agg(*agg)


_CLAIMS = "_claims"  # readers skip names with an underscore


def _hadoop(spark: SparkSession, path: str):
    """(file system, path class) of a folder."""
    cls = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def _files(fs, cls, directory: str) -> list[str]:
    out, it = [], fs.listFiles(cls(directory), True)
    while it.hasNext():
        path = it.next().getPath()
        if not any(x.startswith(("_", ".")) for x in path.toString()[len(fs.makeQualified(cls(directory)).toString()):].split("/")):
            out.append(path.toString())
    return sorted(out)


def claim_lines(spark: SparkSession, directory: str) -> str | None:
    """S9, first step: claim all files that are there now and in no claim yet; the claim's name, or None if there are none.

    The claim is a list of files, written aside and renamed into place, so it exists whole or not at all. Lines that
    arrive later are in other files and wait for the next claim. Claims of one folder are made by one driver at a time.
    """
    fs, cls = _hadoop(spark, directory)
    taken = {f for name in open_claims(spark, directory) for f in _claimed(fs, cls, directory, name)}
    files = [f for f in _files(fs, cls, directory) if f not in taken]
    if not files:
        return None
    name = uuid.uuid4().hex
    fs.mkdirs(cls(f"{directory}/{_CLAIMS}"))
    out = fs.create(cls(f"{directory}/{_CLAIMS}/.{name}"), True)
    out.write(bytearray(json.dumps(files).encode()))
    out.close()
    _rename(fs, cls, f"{directory}/{_CLAIMS}/.{name}", f"{directory}/{_CLAIMS}/{name}.json")
    return name


def _rename(fs, cls, source: str, target: str) -> None:
    if not fs.rename(cls(source), cls(target)):
        raise OSError(f"cannot move {source} to {target}")


def open_claims(spark: SparkSession, directory: str) -> list[str]:
    """Claims whose files have not all been moved away: of this run, or of one that ended early."""
    fs, cls = _hadoop(spark, directory)
    folder = cls(f"{directory}/{_CLAIMS}")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(n[:-5] for n in names if n.endswith(".json"))


def _claimed(fs, cls, directory: str, name: str) -> list[str]:
    stream = fs.open(cls(f"{directory}/{_CLAIMS}/{name}.json"))
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return json.loads(text)


def read_claim(spark: SparkSession, directory: str, name: str, archive_dir: str | None = None) -> DataFrame:
    """S9, second step: the lines of a claim's files, which are then moved to ``archive_dir`` (or deleted).

    The lines are written before a file is moved; run again after a failure at any point, this returns the same
    lines and moves what is left. The claim ends with the last file.
    """
    fs, cls = _hadoop(spark, directory)
    files = _claimed(fs, cls, directory, name)
    kept = f"{directory}/{_CLAIMS}/{name}.lines"
    if not fs.exists(cls(f"{kept}/_SUCCESS")):
        raw = spark.read.option("basePath", directory).text(files)
        lines = raw.select(F.col("rank").cast("string").alias("rank"), F.col("value").alias("line"), python_float("value").alias("value"))
        lines.write.mode("overwrite").parquet(kept)
    base = fs.makeQualified(cls(directory)).toString()
    for f in files:
        if not fs.exists(cls(f)):
            continue
        if archive_dir:
            target = cls(archive_dir + f[len(base):])
            fs.mkdirs(target.getParent())
            if fs.exists(target):  # another claim's file of the same name
                target = cls(f"{target.toString()}.{name}")
            _rename(fs, cls, f, target.toString())
        else:
            fs.delete(cls(f), False)
    _rename(fs, cls, f"{directory}/{_CLAIMS}/{name}.json", f"{directory}/{_CLAIMS}/{name}.done")
    return spark.read.parquet(kept).select(F.col("rank").cast("int").alias("rank"), "line", "value")


def consume_lines(spark: SparkSession, directory: str, archive_dir: str | None = None) -> DataFrame:
    """S9 (batch): all lines not consumed yet, each returned by one call only.

    Takes up the claims that an earlier call left open, and claims what has arrived since.
    """
    claim_lines(spark, directory)
    names = open_claims(spark, directory)
    if not names:
        return spark.createDataFrame([], "rank int, line string, value double")
    return reduce(DataFrame.unionByName, [read_claim(spark, directory, n, archive_dir) for n in names])


def compute_accuracy(spark: SparkSession, directory: str, predictions: DataFrame | None = None,
                     compute_result: bool = False, consume: bool = True,
                     archive_dir: str | None = None) -> DataFrame:
    """The reference's accuracy closure as two Spark steps.

    ``compute_result=False``: per (rank, batch) argmax accuracy of
    ``predictions`` (rank, batch_id, logits, label) is appended as lines
    under each rank's folder; returns the batch accuracies.
    ``compute_result=True``: every rank's lines are read, the unweighted
    mean of the batch values is returned as ``eval_accuracy`` (0.0 when no
    line parses), and the lines are consumed (moved to ``archive_dir`` or
    deleted) unless ``consume=False``.
    """
    from vqaframe.operators.metrics import batch_accuracy
    if not compute_result:
        written = shared_dir(spark, "batch-accuracy")  # used twice: appended, and returned
        batch_accuracy(predictions).write.parquet(written)
        acc = spark.read.parquet(written)
        append_metric_lines(acc.select("rank", F.col("accuracy").alias("value")), directory)
        return acc.select("rank", "batch_id", F.col("accuracy").alias("eval_accuracy"))
    lines = consume_lines(spark, directory, archive_dir) if consume else read_metric_lines(spark, directory)
    return mean_of_lines(lines).select(F.col("mean_value").alias("eval_accuracy"))
