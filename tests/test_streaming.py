from pyspark.sql import functions as F

from vqaframe.operators import metrics as M
from vqaframe.sources import metric_lines as ML
from vqaframe.streaming import accuracy as X


def test_incremental_accuracy_equals_batch(spark, tmp):
    lines = f"{tmp}/lines"
    out, ckpt = f"{tmp}/state", f"{tmp}/ckpt"
    batches = spark.createDataFrame(
        [(0, 0, 0.5), (0, 4, 1.0), (1, 1, 0.25), (2, 2, 0.0), (3, 3, 0.75)],
        "rank int, batch_id long, accuracy double")
    ML.append_metric_lines(batches.select("rank", F.col("accuracy").alias("value")), lines)
    ML.append_metric_lines(spark.createDataFrame([(1, "junk line")], "rank int, value string"), lines)
    X.run_incremental_accuracy(spark, lines, ckpt, out)
    per = {r["rank"]: r for r in spark.read.parquet(out).collect()}
    assert per[0]["n_values"] == 2 and abs(per[0]["mean_value"] - 0.75) < 1e-12
    streamed = X.overall_mean(spark.read.parquet(out)).first()["mean_accuracy"]
    batch = M.mean_of_batches(batches).first()["mean_accuracy"]
    assert abs(streamed - batch) < 1e-12
    # a later evaluation batch arrives: only the new file is read, state continues
    ML.append_metric_lines(spark.createDataFrame([(2, 1.0)], "rank int, value double"), lines)
    X.run_incremental_accuracy(spark, lines, ckpt, out)
    per = {r["rank"]: r for r in spark.read.parquet(out).collect()}
    assert per[2]["n_values"] == 2 and abs(per[2]["mean_value"] - 0.5) < 1e-12


def test_stream_consumes_files_once(spark, tmp):
    lines, archive = f"{tmp}/lines", f"{tmp}/archive"
    out, ckpt = f"{tmp}/state", f"{tmp}/ckpt"
    ML.append_metric_lines(spark.createDataFrame([(0, 0.5), (1, 0.25)], "rank int, value double"), lines)
    X.run_incremental_accuracy(spark, lines, ckpt, out, clean_source="archive", archive_dir=archive)
    per = {r["rank"]: r["n_values"] for r in spark.read.parquet(out).collect()}
    assert per == {0: 1, 1: 1}
