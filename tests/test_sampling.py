import hashlib

import pytest
from pyspark.sql import functions as F

from vqaframe.operators import sampling as S
from vqaframe.operators.batch import assemble_batches, assign_batches
from vqaframe.operators.rowindex import with_row_index
from vqaframe.operators.sampling import exact_sample


def brute(ids, k, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))
    return set(order[:k])


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 3000).withColumnRenamed("id", "k")


@pytest.mark.parametrize("p", [0.0, 0.001, 0.29, 0.5, 1.0])
def test_exact_fraction_matches_brute_force(spark, ids, p):
    s = exact_sample(ids, ["k"], fraction=p)
    got = {r["k"] for r in s.collect()}
    assert len(got) == int(p * 3000)
    assert got == brute(range(3000), int(p * 3000))


def test_independent_of_partitioning_and_nested(spark, ids):
    a = {r["k"] for r in exact_sample(ids.repartition(3), ["k"], fraction=0.2).collect()}
    b = {r["k"] for r in exact_sample(ids.repartition(11), ["k"], fraction=0.2).collect()}
    c = {r["k"] for r in exact_sample(ids, ["k"], fraction=0.4).collect()}
    assert a == b and a <= c


def test_refinement_levels_and_distributed_tail(spark, ids):
    # tiny small_cut forces deeper hash levels and the distributed rank path
    s = exact_sample(ids, ["k"], k=1234, small_cut=0)
    assert {r["k"] for r in s.collect()} == brute(range(3000), 1234)


def test_cap_and_bad_fraction(spark, ids):
    assert exact_sample(ids, ["k"], cap=10).count() == 10
    assert exact_sample(ids, ["k"], cap=10 ** 6).count() == 3000
    with pytest.raises(ValueError):
        exact_sample(ids, ["k"], fraction=-0.1)


def test_duplicate_keys_deterministic(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "k int, v string")
    a = sorted(r["v"] for r in exact_sample(df, ["k"], k=2).collect())
    b = sorted(r["v"] for r in exact_sample(df.repartition(3), ["k"], k=2).collect())
    assert a == b and len(a) == 2


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    out = with_row_index(df, [F.desc("v")], "i", num_partitions=4).collect()
    pairs = sorted((r["i"], r["v"]) for r in out)
    assert [i for i, _ in pairs] == list(range(1000))
    assert [v for _, v in pairs] == sorted(range(1000), reverse=True)


def test_batches_partition_rows(spark):
    df = spark.range(0, 50).withColumn("label", (F.col("id") % 3).cast("int"))
    b = assign_batches(df, 16, order_cols=[F.col("id")])
    dense = assign_batches(df, 16, dense_id="id")
    keyed = assign_batches(df, 16, order_cols=[F.col("id")], key_cols=["id"])
    assert sorted(tuple(r) for r in keyed.select("id", "batch_id", "batch_pos", "label").collect()) == \
        sorted(tuple(r) for r in dense.select("id", "batch_id", "batch_pos", "label").collect())
    assert sorted(tuple(r) for r in b.select("id", "batch_id", "batch_pos").collect()) == \
        sorted(tuple(r) for r in dense.select("id", "batch_id", "batch_pos").collect())
    a = {r["batch_id"]: r for r in assemble_batches(b, ["id", "label"]).collect()}
    assert [a[i]["n_rows"] for i in range(4)] == [16, 16, 16, 2]  # short last batch
    assert a[1]["id"] == list(range(16, 32))
    with pytest.raises(ValueError):
        assign_batches(df, 0, dense_id="id")


def test_empty_input(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert exact_sample(empty, ["k"], fraction=0.5).count() == 0
    assert exact_sample(empty, ["k"], cap=10).count() == 0


def test_hot_duplicate_key_a_third_of_rows(spark):
    # one key holds a third of all rows: refinement stops at once, result exact
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"))
    s = exact_sample(df, ["k"], k=1500, small_cut=10)
    rows = s.collect()
    assert len(rows) == 1500
    again = exact_sample(df.repartition(7), ["k"], k=1500, small_cut=10)
    assert sorted(r["v"] for r in rows) == sorted(r["v"] for r in again.collect())


def _order(rows, seed):
    return sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0]))


@pytest.mark.parametrize("small", [1_000_000, 3, 1])
def test_places_in_the_shuffle(spark, small):
    """Ranges are refined until each holds at most ``small`` rows; the places don't change."""
    rows = [(i, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = S.shuffled(df, ["k"], seed=7, small=small)
    assert got.columns == ["k", "t", "position"]
    assert [(r["k"], r["t"]) for r in sorted(got.collect(), key=lambda r: r["position"])] == _order(rows, 7)
    assert sorted(r["position"] for r in got.collect()) == list(range(400))


def test_places_of_one_hot_key(spark):
    rows = [(1, f"t{i}") for i in range(200)] + [(i, "x") for i in range(2, 60)] + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    for small in (1_000_000, 20):
        got = S.shuffled(df, ["k"], seed=7, small=small).collect()
        assert sorted(r["position"] for r in got) == list(range(len(rows)))
        hot = sorted(r["position"] for r in got if r["k"] == 1)
        assert hot == list(range(hot[0], hot[0] + 200)) and {r["t"] for r in got if r["k"] == 1} == {f"t{i}" for i in range(200)}
    assert S.shuffled(df.limit(0), ["k"]).count() == 0


def test_sample_with_places_from_pinned_keys(spark):
    rows = [(i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    for options in ({"fraction": 0.29}, {"cap": 7}, {"cap": 1000}, {"fraction": 0.0}):
        k = min(options.get("cap", int(options.get("fraction", 0) * 300)), 300)
        for small in (1_000_000, 4):
            got = S.exact_sample(df, ["k"], seed=3, small_cut=small, pin_keys=True, position_col="at", **options).collect()
            assert [(r["k"], r["t"]) for r in sorted(got, key=lambda r: r["at"])] == _order(rows, 3)[:k]
            assert sorted(r["at"] for r in got) == list(range(k))
