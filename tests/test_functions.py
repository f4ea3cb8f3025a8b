import math

import numpy as np
from pyspark.sql import functions as F

from vqaframe.functions import (
    argmax,
    index_range,
    log_sum_exp,
    ngrams,
    nll,
    safe_slice,
    whitespace_tokens,
)


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([(" a  b\tc\nd ",), ("",), (None,), ("x",)], "t string")
    rows = df.select(whitespace_tokens("t").alias("w")).collect()
    assert [r["w"] for r in rows] == [["a", "b", "c", "d"], [], None, ["x"]]
    g = df.select(ngrams(whitespace_tokens("t"), 2).alias("g")).collect()
    assert [r["g"] for r in g] == [["a b", "b c", "c d"], [], None, []]


def test_ranges_and_slices(spark):
    df = spark.createDataFrame([(0,), (3,), (-2,)], "n int")
    assert [r[0] for r in df.select(index_range("n")).collect()] == [[], [0, 1, 2], []]
    a = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    got = a.select(safe_slice("a", F.lit(2), F.lit(5)), safe_slice("a", F.lit(4), F.lit(1)),
                   safe_slice("a", F.lit(1), F.lit(-3))).first()
    assert list(got) == [[2, 3], [], []]


def test_log_sum_exp_and_nll(spark):
    x = [1000.0, 1000.5, -3.0]
    df = spark.createDataFrame([(x, 1)], "x array<double>, y int")
    r = df.select(log_sum_exp("x").alias("l"), nll("x", "y").alias("n"), argmax("x").alias("a")).first()
    ref = 1000.5 + math.log(sum(math.exp(v - 1000.5) for v in x))
    assert abs(r["l"] - ref) < 1e-9 and abs(r["n"] - (ref - 1000.5)) < 1e-9
    assert r["a"] == int(np.argmax(x))
