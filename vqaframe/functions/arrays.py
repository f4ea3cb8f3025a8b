"""Array expressions used by encoders and metrics; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(c) -> Column:
    """0-based index of the first maximum (NaN counts as the greatest, as in numpy)."""
    a = _col(c)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def log_sum_exp(c) -> Column:
    """Stable ``log(sum(exp(x)))`` of a numeric array, in double precision."""
    a = F.transform(_col(c), lambda x: x.cast("double"))
    m = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(total)


def nll(logits, label) -> Column:
    """Negative log-likelihood of ``label`` (0-based) under softmax(logits)."""
    a = _col(logits)
    return log_sum_exp(a) - F.element_at(a, _col(label) + F.lit(1)).cast("double")


def index_range(n) -> Column:
    """[0, 1, ..., n-1]; empty for n <= 0 (``sequence(0, n-1)`` alone would count down)."""
    k = _col(n)
    return F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def safe_slice(c, start, length) -> Column:
    """``slice`` with a 1-based start and a length clamped at zero."""
    return F.slice(_col(c), start, F.greatest(length, F.lit(0)))
