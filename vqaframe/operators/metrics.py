"""Evaluation metrics as distributed aggregates.

Every metric is a sum/count pair reduced by Spark's partial + final
aggregation; per-example work stays in array expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.functions.arrays import argmax, nll
from vqaframe.functions.strings import ngrams
from vqaframe.operators.encode import IGNORE_INDEX


def batch_accuracy(df: DataFrame, logits_col: str = "logits", label_col: str = "label",
                   group_cols: tuple = ("rank", "batch_id"),
                   ignore_index: int | None = None, shift: bool = False,
                   seq_cols: list[str] | None = None, pos_col: str = "pos") -> DataFrame:
    """A2: per batch, mean of (argmax(logits) == label) over every position.

    As in the reference there is no shift and no masking by default; pass
    ``ignore_index`` to leave such labels out of numerator and denominator.
    ``shift=True`` scores the prediction at t against the label at t + 1 of
    the same sequence (``seq_cols``, ordered by ``pos_col``); the last
    position of each sequence then has nothing to score.
    """
    d = df
    label = F.col(label_col)
    if shift:
        if not seq_cols:
            raise ValueError("shift needs seq_cols")
        d = shift_next(d, seq_cols, pos_col, [label_col]).filter(F.col(f"next_{label_col}").isNotNull())
        label = F.col(f"next_{label_col}")
    hit = (argmax(logits_col) == label).cast("double")
    if ignore_index is not None:
        d = d.filter(label != ignore_index)
    return d.groupBy(*group_cols).agg(F.avg(hit).alias("accuracy"),
                                      F.count(F.lit(1)).alias("n_positions"))


def mean_of_batches(batches: DataFrame, value_col: str = "accuracy",
                    group_cols: tuple = ()) -> DataFrame:
    """A3: unweighted mean of batch values (sum/count); 0.0 when there are none."""
    agg = [F.coalesce(F.sum(value_col) / F.count(value_col), F.lit(0.0)).alias("mean_accuracy"),
           F.count(value_col).alias("n_batches")]
    return batches.groupBy(*group_cols).agg(*agg) if group_cols else batches.agg(*agg)


def next_token_pairs(df: DataFrame, keys: list[str], tokens_col: str) -> DataFrame:
    """W1 (array form): pair token t with token t+1 inside each row; no shuffle."""
    t = F.col(tokens_col)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    z = F.arrays_zip(F.slice(t, 1, m).alias("token"), F.slice(t, 2, m).alias("next_token"))
    return (df.select(*keys, F.posexplode(z).alias("pos", "_z"))
            .select(*keys, F.col("pos").cast("int").alias("pos"),
                    F.col("_z.token").alias("token"), F.col("_z.next_token").alias("next_token")))


def shift_next(df: DataFrame, seq_cols: list[str], pos_col: str, cols: list[str]) -> DataFrame:
    """W1 (long form): ``next_<c>`` = value at the following position of the sequence.

    Window partitions are sequences, bounded by the context length.
    """
    w = Window.partitionBy(*seq_cols).orderBy(pos_col)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})


def masked_cross_entropy(df: DataFrame, seq_cols: list[str], pos_col: str = "pos",
                         logits_col: str = "logits", label_col: str = "label",
                         mask_col: str | None = "attention_mask",
                         ignore_index: int = IGNORE_INDEX, group_cols: tuple = ()) -> DataFrame:
    """A4: mean next-token cross-entropy with the reference's masking.

    Logits at position t are scored against the label at t+1; positions
    whose shifted attention mask is 0 or whose label is ``ignore_index`` are
    left out. No position left gives NaN (as the original loss does).
    """
    cols = [label_col] + ([mask_col] if mask_col else [])
    s = shift_next(df, seq_cols, pos_col, cols)
    keep = F.col(f"next_{label_col}").isNotNull() & (F.col(f"next_{label_col}") != ignore_index)
    if mask_col:
        keep = keep & (F.col(f"next_{mask_col}") != 0)
    s = s.filter(keep).withColumn("_nll", nll(logits_col, F.col(f"next_{label_col}")))
    agg = [F.coalesce(F.avg("_nll"), F.lit(float("nan"))).alias("loss"),
           F.count(F.lit(1)).alias("n_positions")]
    return s.groupBy(*group_cols).agg(*agg) if group_cols else s.agg(*agg)


def clipped_counts(df: DataFrame, keys: list[str], hyp_col: str, ref_col: str,
                   max_n: int = 1) -> DataFrame:
    """Per row: lengths and, for n = 1..max_n, sum over n-grams of min(hyp count, ref count).

    One pass, no join: every row emits a length marker plus its hypothesis
    and reference n-grams tagged (side, n); one aggregation counts each
    (row, n, n-gram) with map-side combine, a second sums the clipped counts
    per row. Groups are one row's n-grams, so no group outgrows a text.
    """
    def tagged(col: str, side: int, n: int):
        return F.transform(ngrams(col, n), lambda g: F.struct(
            F.lit(side).alias("side"), F.lit(n).alias("n"), g.alias("g"),
            F.lit(0).alias("hl"), F.lit(0).alias("rl")))

    marker = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("n"),
                              F.lit(None).cast("string").alias("g"),
                              F.size(hyp_col).alias("hl"), F.size(ref_col).alias("rl")))
    items = F.concat(marker, *[tagged(hyp_col, 1, n) for n in range(1, max_n + 1)],
                     *[tagged(ref_col, 2, n) for n in range(1, max_n + 1)])
    ex = df.select(*keys, F.inline(items))
    per_gram = ex.groupBy(*keys, "n", "g").agg(
        F.sum((F.col("side") == 1).cast("long")).alias("hc"),
        F.sum((F.col("side") == 2).cast("long")).alias("rc"),
        F.max("hl").alias("hl"), F.max("rl").alias("rl"))
    clip = F.least("hc", "rc")
    return per_gram.groupBy(*keys).agg(
        F.max("hl").alias("hyp_len"), F.max("rl").alias("ref_len"),
        *[F.coalesce(F.sum(F.when(F.col("n") == n, clip)), F.lit(0)).cast("long").alias(f"clip_{n}")
          for n in range(1, max_n + 1)])


def sentence_bleu(df: DataFrame, keys: list[str], hyp_col: str, ref_col: str,
                  max_n: int = 1) -> DataFrame:
    """BLEU-``max_n`` per row (uniform weights, no smoothing; Papineni et al. 2002).

    ``hyp_col`` and ``ref_col`` are token arrays. Brevity penalty is
    exp(1 - r/c) when the hypothesis is shorter, and 0 for an empty one.
    """
    out = clipped_counts(df, keys, hyp_col, ref_col, max_n)
    c, r = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(c == 0, F.lit(0.0)).when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    logp = None
    any_zero = None
    for n in range(1, max_n + 1):
        total = F.greatest(c - (n - 1), F.lit(0))
        term = F.log(F.col(f"clip_{n}") / total) / max_n
        logp = term if logp is None else logp + term
        z = F.col(f"clip_{n}") == 0
        any_zero = z if any_zero is None else (any_zero | z)
    bleu = F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(logp))
    return out.select(*keys, "hyp_len", "ref_len",
                      *[f"clip_{n}" for n in range(1, max_n + 1)], bleu.alias(f"bleu{max_n}"))


def corpus_bleu(per_row: DataFrame, max_n: int = 1, with_mean: bool = False) -> DataFrame:
    """A9 at corpus level from ``sentence_bleu`` rows: summed counts, one penalty.

    ``with_mean`` adds the mean sentence score and the row count from the
    same aggregation.
    """
    agg = [F.sum("hyp_len").alias("c"), F.sum("ref_len").alias("r")]
    if with_mean:
        agg += [F.avg(f"bleu{max_n}").alias(f"mean_bleu{max_n}"), F.count(F.lit(1)).alias("n_rows")]
    agg += [F.sum(f"clip_{n}").alias(f"m{n}") for n in range(1, max_n + 1)]
    agg += [F.sum(F.greatest(F.col("hyp_len") - (n - 1), F.lit(0))).alias(f"t{n}")
            for n in range(1, max_n + 1)]
    s = per_row.agg(*agg)
    c, r = F.col("c"), F.col("r")
    bp = F.when(c == 0, F.lit(0.0)).when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    logp = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) / max_n for n in range(2, max_n + 1)),
               F.log(F.col("m1") / F.col("t1")) / max_n)
    zero = F.lit(False)
    for n in range(1, max_n + 1):
        zero = zero | (F.coalesce(F.col(f"m{n}"), F.lit(0)) == 0)
    extra = [f"mean_bleu{max_n}", "n_rows"] if with_mean else []
    return s.select(F.when(zero, F.lit(0.0)).otherwise(bp * F.exp(logp)).alias(f"corpus_bleu{max_n}"),
                    *extra)
