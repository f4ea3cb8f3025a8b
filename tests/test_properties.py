"""Property tests with generated inputs (hypothesis), one Spark job per example."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from vqaframe.functions.parse import python_float

ALPHABET = list("0123456789") * 3 + list("._eE+- \t") + ["_", "nan", "inf", "inity", "d", "x", "\n"]
token = st.lists(st.sampled_from(ALPHABET), min_size=0, max_size=8).map("".join)


def py_float(s):
    try:
        return float(s.strip())
    except ValueError:
        return None


@settings(max_examples=8, deadline=None)
@given(st.lists(token, min_size=50, max_size=200))
def test_python_float_matches_python(spark, lines):
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    got = [r[0] for r in df.select(python_float("line")).collect()]
    for s, g in zip(lines, got):
        e = py_float(s)
        if e is None:
            assert g is None, repr(s)
        elif math.isnan(e):
            assert g is not None and math.isnan(g), repr(s)
        else:
            assert g == e, repr(s)


def _brute_sample(keys, k, seed=42):
    import hashlib
    order = sorted(keys, key=lambda x: (hashlib.md5(f"{x}:{seed}".encode()).hexdigest(), x))
    return set(order[:k])


@settings(max_examples=6, deadline=None)
@given(keys=st.sets(st.text(min_size=1, max_size=6), min_size=1, max_size=300),
       frac=st.floats(min_value=0.0, max_value=1.0), parts=st.integers(min_value=1, max_value=9))
def test_exact_sample_equals_sorted_prefix(spark, keys, frac, parts):
    from vqaframe.operators.sampling import exact_sample
    keys = sorted(keys)
    df = spark.createDataFrame([(x,) for x in keys], "k string").repartition(parts)
    got = {r["k"] for r in exact_sample(df, ["k"], fraction=frac, small_cut=5).collect()}
    assert got == _brute_sample(keys, int(frac * len(keys)))


def _brute_bleu(hyp, ref, max_n):
    from collections import Counter
    if not hyp:
        return 0.0
    logs = 0.0
    for n in range(1, max_n + 1):
        h = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        r = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
        m = sum(min(c, r[g]) for g, c in h.items())
        if m == 0:
            return 0.0
        logs += math.log(m / (len(hyp) - n + 1)) / max_n
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return bp * math.exp(logs)


words = st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=0, max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=40), st.integers(min_value=1, max_value=3))
def test_sentence_bleu_matches_definition(spark, pairs, n):
    from vqaframe.operators.metrics import sentence_bleu
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)],
                               "k int, hyp array<string>, ref array<string>")
    got = {r["k"]: r[f"bleu{n}"] for r in sentence_bleu(df, ["k"], "hyp", "ref", n).collect()}
    for i, (h, r) in enumerate(pairs):
        assert abs(got[i] - _brute_bleu(h, r, n)) < 1e-12, (h, r, n)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=0, max_size=300),
       st.integers(min_value=1, max_value=7), st.booleans())
def test_row_index_equals_sorted_order(spark, values, parts, descending):
    from pyspark.sql import functions as F

    from vqaframe.operators.rowindex import with_row_index
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(parts)
    order = [F.desc("v") if descending else F.asc("v"), F.asc("id")]
    got = sorted((r["i"], r["id"]) for r in with_row_index(df, order, "i").collect())
    expect = sorted(rows, key=lambda r: ((-r[1]) if descending else r[1], r[0]))
    assert [i for i, _ in got] == list(range(len(rows)))
    assert [rid for _, rid in got] == [r[0] for r in expect]


def _ref_truncate(la, lb, L):
    if la + lb <= L:
        return la, lb
    swap = la > lb
    n1, n2 = (lb, la) if swap else (la, lb)
    n2 = n1 if n1 > L else max(n1, L - n1)
    if n1 + n2 > L:
        n1, n2 = L // 2, L // 2 + L % 2
    return (n2, n1) if swap else (n1, n2)


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=1, max_value=40),
       st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=200))
def test_truncation_lengths_match_closed_form(spark, L, pairs):
    from pyspark.sql import functions as F

    from vqaframe.operators.encode import _pair_lengths
    df = spark.createDataFrame(pairs, "la int, lb int")
    ka, kb = _pair_lengths(F.col("la"), F.col("lb"), L)
    got = [(r[0], r[1], r[2], r[3]) for r in df.select("la", "lb", ka, kb).collect()]
    for la, lb, a, b in got:
        assert (a, b) == _ref_truncate(la, lb, L), (la, lb, L)
        assert a + b <= L or (la + lb <= L)
