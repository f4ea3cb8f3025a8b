import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vqaframe.functions.arrays import argmax
from vqaframe.operators import metrics as M


def test_argmax_ties_and_nan(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([float("nan"), 5.0],), ([2.0, float("nan")],)],
                               "a array<double>")
    got = [r[0] for r in df.select(argmax("a")).collect()]
    assert got == [int(np.argmax([1, 3, 3])), int(np.argmax([np.nan, 5])), int(np.argmax([2, np.nan]))]


def _preds(spark):
    rows = [
        (0, 0, [0.1, 0.9], 1), (0, 0, [0.8, 0.2], 1),   # batch 0 rank 0: 0.5
        (0, 1, [0.5, 0.5], 0), (0, 1, [0.5, 0.5], 0),   # tie -> first wins: 1.0
        (1, 2, [0.2, 0.1], 1),                          # rank 1: 0.0 (short batch)
    ]
    return spark.createDataFrame(rows, "rank int, batch_id long, logits array<double>, label int")


def test_batch_accuracy_and_unweighted_mean(spark):
    b = M.batch_accuracy(_preds(spark))
    acc = {r["batch_id"]: r["accuracy"] for r in b.collect()}
    assert acc == {0: 0.5, 1: 1.0, 2: 0.0}
    m = M.mean_of_batches(b).first()
    assert abs(m["mean_accuracy"] - 0.5) < 1e-12 and m["n_batches"] == 3  # not 3/5 over rows
    empty = M.mean_of_batches(b.filter("false")).first()
    assert empty["mean_accuracy"] == 0.0
    ign = {r["batch_id"]: r["accuracy"] for r in M.batch_accuracy(_preds(spark), ignore_index=0).collect()}
    assert ign == {0: 0.5, 2: 0.0}


def test_masked_cross_entropy_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows, expect = [], []
    for ex in range(4):
        T = 5
        logits = rng.normal(size=(T, 6))
        labels = rng.integers(0, 6, size=T).tolist()
        labels[2] = -100
        mask = [1, 1, 1, 1, 0] if ex % 2 else [1] * T
        for t in range(T):
            rows.append((ex, t, logits[t].tolist(), labels[t], mask[t]))
        for t in range(T - 1):
            if mask[t + 1] != 0 and labels[t + 1] != -100:
                x = logits[t]
                expect.append(np.log(np.exp(x - x.max()).sum()) + x.max() - x[labels[t + 1]])
    df = spark.createDataFrame(rows, "ex int, pos int, logits array<double>, label int, attention_mask int")
    got = M.masked_cross_entropy(df, ["ex"], "pos").first()
    assert got["n_positions"] == len(expect)
    assert abs(got["loss"] - float(np.mean(expect))) < 1e-9
    none = M.masked_cross_entropy(df.withColumn("label", F.lit(-100)), ["ex"], "pos").first()
    assert math.isnan(none["loss"])


def test_next_token_pairs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "k int, t array<string>")
    got = [tuple(r) for r in M.next_token_pairs(df, ["k"], "t").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "a", "b"), (1, 1, "b", "c")]


def brute_bleu(hyp, ref, max_n):
    if not hyp:
        return 0.0
    logs = 0.0
    for n in range(1, max_n + 1):
        h = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        r = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
        m = sum(min(c, r[g]) for g, c in h.items())
        total = max(len(hyp) - n + 1, 0)
        if m == 0:
            return 0.0
        logs += math.log(m / total) / max_n
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return bp * math.exp(logs)


def test_sentence_bleu_matches_brute_force(spark):
    pairs = [(1, "the cat sat on the mat", "the cat is on the mat"),
             (2, "the the the", "the cat"),
             (3, "", "a b"),
             (4, "a b c d e", "a b c d e"),
             (5, "x y", "a b c d")]
    df = spark.createDataFrame(pairs, "k int, h string, r string").select(
        "k", F.split("h", " ").alias("hyp"), F.split("r", " ").alias("ref"))
    df = df.withColumn("hyp", F.filter("hyp", lambda x: x != ""))
    for n in (1, 2):
        got = {r["k"]: r[f"bleu{n}"] for r in M.sentence_bleu(df, ["k"], "hyp", "ref", n).collect()}
        for k, h, r in pairs:
            assert abs(got[k] - brute_bleu(h.split(), r.split(), n)) < 1e-12, (k, n)
    per = M.sentence_bleu(df, ["k"], "hyp", "ref", 1)
    c = M.corpus_bleu(per, 1).first()[0]
    hyp = sum(len(h.split()) for _, h, _ in pairs)
    ref = sum(len(r.split()) for _, _, r in pairs)
    clip = sum(sum(min(cn, Counter(r.split())[g]) for g, cn in Counter(h.split()).items())
               for _, h, r in pairs)
    bp = 1.0 if hyp > ref else math.exp(1 - ref / hyp)
    assert abs(c - bp * clip / hyp) < 1e-12


def test_batch_accuracy_with_shift(spark):
    rows = [(0, 0, 0, [0.9, 0.1], 1), (0, 0, 1, [0.1, 0.9], 0), (0, 0, 2, [0.9, 0.1], 1)]
    df = spark.createDataFrame(rows, "rank int, batch_id long, pos int, logits array<double>, label int")
    plain = M.batch_accuracy(df).first()
    assert abs(plain["accuracy"] - 0.0) < 1e-12 and plain["n_positions"] == 3
    shifted = M.batch_accuracy(df, shift=True, seq_cols=["batch_id"]).first()
    # pred(t=0)=0 vs label(1)=0 hit; pred(t=1)=1 vs label(2)=1 hit
    assert shifted["accuracy"] == 1.0 and shifted["n_positions"] == 2
