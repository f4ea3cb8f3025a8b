"""A key holding a third of all rows: results stay whole, the hot partition is split."""

from pyspark.sql import functions as F

from vqaframe.operators import prepare as P
from vqaframe.operators.metrics import batch_accuracy
from vqaframe.session import literal_frame


def test_hot_question_id_join_is_split_and_complete(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        # a third of all annotations belong to question 7
        ann = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("question_id"),
            F.lit(1).alias("image_id"), F.lit("t").alias("question_type"), F.lit("a").alias("answer_type"),
            F.col("id").cast("string").alias("multiple_choice_answer"),
            F.array().cast("array<struct<answer:string>>").alias("answers"))
        qs = spark.range(n).select(F.col("id").alias("question_id"), F.col("id").alias("image_id"),
                                   F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"))
        j = P.join_questions_annotations(qs, ann)
        assert j.count() == n  # every annotation has its question: nothing dropped or capped
        hot = j.filter("question_id = 7").count()
        assert hot == n // 3 + (0 if 7 % 3 == 0 else 1)
        j.collect()  # run the Dataset's own execution so its adaptive plan is final
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_batch_key_aggregates_partially(spark):
    # one (rank, batch) holding a third of the rows is pre-aggregated map-side
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5).cast("int").alias("rank"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("batch_id"),
        F.array(F.lit(0.1), F.lit(0.9)).alias("logits"), F.lit(1).alias("label"))
    acc = batch_accuracy(df)
    plan = acc._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan or "partial_" in plan
    row = acc.filter("rank = 0 AND batch_id = 0").first()
    assert row["n_positions"] == 3000 and row["accuracy"] == 1.0


def test_hot_token_lookup_without_broadcast(spark):
    from vqaframe.operators import encode as E
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        words = spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), F.col("id").cast("string")))
            .alias("token"), F.col("id").alias("doc"))
        vocab = literal_frame(spark, [("the", 10)], [("token", "string"), ("id", "int")])
        out = E.lookup_ids(words, vocab, max_broadcast=0)  # vocabulary "too large": shuffle join
        rows = out.collect()
        assert len(rows) == 30000
        assert sum(1 for r in rows if r["token_id"] == 10) == 10000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
