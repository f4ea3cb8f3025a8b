"""Checks that cannot be pruned, exact row values, null keys, offsets of many partitions, generator input."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vqaframe.operators import encode as E
from vqaframe.operators import generate as G
from vqaframe.operators.rowindex import add_offsets, with_row_index
from vqaframe.operators.sampling import exact_sample
from vqaframe.operators.udf import map_rows
from vqaframe.sources import images


def test_map_rows_keeps_exact_values(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, big, "a"), (2, None, None)], "id long, n long, s string")
    seen = map_rows(df, lambda r: {"id": r["id"], "n": r["n"], "kind": type(r["n"]).__name__}, "id long, n long, kind string, gone int")
    assert [tuple(r) for r in seen.orderBy("id").collect()] == [(1, big, "int", None), (2, None, "NoneType", None)]


def test_invalid_media_fail_even_when_pruned(spark):
    media = spark.createDataFrame([("a", 0, "audio", "x", None)], "request_id string, pos int, type string, location string, text string")
    checked = G.validate_media(media, on_invalid="error")
    with pytest.raises(PySparkException):
        checked.count()
    with pytest.raises(PySparkException):
        checked.select("request_id").collect()


def test_missing_and_ambiguous_images_fail_even_when_pruned(spark):
    listing = spark.createDataFrame([("a.jpg", "/x/a.jpg", 3), ("b.jpg", "/x/b.jpg", 4), ("b.jpg", "/y/b.jpg", 5)],
                                    "file_name string, path string, length long")
    ask = lambda name, col="image_file": spark.createDataFrame([(name,)], f"{col} string")
    one = listing.filter("path != '/y/b.jpg'")
    assert images.attach_images(ask("a.jpg"), one).count() == 1
    with pytest.raises(PySparkException):
        images.attach_images(ask("c.jpg"), one).count()
    with pytest.raises(PySparkException):
        images.attach_images(ask("b.jpg"), listing).count()
    by_path = images.attach_images(ask("/y/b.jpg"), listing, name_col="path").collect()
    assert [(r.image_uri, r.image_bytes) for r in by_path] == [("/y/b.jpg", 5)]


@pytest.mark.parametrize("small_cut", [1, 10, 1_000_000])
def test_sample_with_null_keys(spark, small_cut):
    rows = [(None if i % 3 == 0 else i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, v int")
    whole = {r.v for r in df.collect()}
    for k in (1, 29, 45, 89):
        got = [r.v for r in exact_sample(df, ["k"], k=k, small_cut=small_cut).collect()]
        assert len(got) == len(set(got)) == k and set(got) <= whole
        assert sorted(got) == sorted(r.v for r in exact_sample(df, ["k"], k=k).collect())


def test_offsets_of_many_partitions_plan_quickly(spark):
    tagged = spark.range(10).select((F.col("id") * (1 << 33) * 2000).alias("_mid"))
    began = time.monotonic()
    out = add_offsets(tagged, {p: 2 for p in range(20_000)}, "row_idx").collect()
    assert time.monotonic() - began < 10
    assert sorted(r.row_idx for r in out) == [p * 2 * 2000 for p in range(10)]
    assert with_row_index(spark.range(0), [F.col("id")]).count() == 0


def test_generation_sees_the_image_in_several_tasks(spark, tmp_path):
    def make_looker():
        return lambda prompt, image: f"{image}: {prompt}"

    asked = [("same words", f"{i}.jpg") for i in range(64)] + [("same words", None)]
    df = spark.createDataFrame(asked, "prompt string, image string").withColumn(
        "cache_key", G.cache_key(F.lit(1), F.lit(0), F.lit("m"), G.prompt_uid("prompt", "image")))
    out = G.memoised_generate(df, str(tmp_path / "cache"), make_looker, media_cols=("image",), partitions=7)
    assert {r.output for r in out.collect()} == {f"{i}: {p}" for p, i in asked}
    runs = spark.read.parquet(str(tmp_path / "cache")).select(F.input_file_name().alias("f")).distinct().count()
    assert runs > 1
    again = G.memoised_generate(df, str(tmp_path / "cache"), make_looker, media_cols=("image",))
    assert all(r.cached for r in again.collect())


@pytest.mark.parametrize("side", ["right", "left"])
@pytest.mark.parametrize("bos", [False, True])
def test_array_encoding_equals_its_definition(spark, side, bos):
    L, patches, sa = 12, 4, int(bos)
    pairs = [(i, list(range(10, 10 + q)), list(range(50, 50 + a))) for i, (q, a) in
             enumerate([(0, 0), (2, 3), (9, 1), (1, 15), (20, 20), (4, 4), (8, 0)])] + [(99, None, None)]
    df = spark.createDataFrame(pairs, "k int, q array<int>, a array<int>")
    out = E.encode_pair_ids(df, ["k"], "q", "a", text_length=L - patches, num_patches=patches, image_token_id=7,
                            padding_side=side, add_bos=bos, bos_id=2)
    rows = {r.k: r for r in out.collect()}
    for k, q, a in pairs:
        x, y = [7] * patches + (q or []), (a or []) + [E.EOS_ID]
        while len(x) + len(y) > L - 2 * sa:  # longest first, the second of equal ones
            (x if len(x) > len(y) else y).pop()
        ids = [2] * sa + x + [2] * sa + y
        types = [0] * (sa + len(x)) + [1] * (sa + len(y))
        pad = L - len(ids)
        put = (lambda v, p: v + [p] * pad) if side == "right" else (lambda v, p: [p] * pad + v)
        r = rows[k]
        assert r.input_id == put(ids, E.PAD_ID) and r.token_type == put(types, 0)
        assert r.attention_mask == put([1] * len(ids), 0)
        assert r.label == put([i if t else E.IGNORE_INDEX for i, t in zip(ids, types, strict=True)], E.IGNORE_INDEX)
    long = E.positions(out, ["k"]).collect()
    assert sorted((r.k, r.pos, r.input_id, r.label) for r in long) == sorted(
        (k, p, r.input_id[p], r.label[p]) for k, r in rows.items() for p in range(L))
