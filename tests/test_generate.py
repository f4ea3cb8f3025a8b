import pytest
from pyspark.sql import functions as F

from vqaframe.operators import generate as G
from vqaframe.operators.udf import factory_key, map_rows, per_worker


def test_expand_completions(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "r int, num_completions int")
    got = sorted(tuple(r) for r in G.expand_completions(df).select("r", "i").collect())
    assert got == [(2, 0), (3, 0), (3, 1), (3, 2)]


def _media(spark):
    rows = [("a", 0, "image", "img1.jpg", None), ("a", 1, "text", None, "What "),
            ("a", 2, "image", "img2.jpg", None), ("a", 3, "text", None, "is {x}?"),
            ("b", 0, "image", "", None), ("b", 1, "text", None, None), ("b", 2, "audio", None, "x"),
            ("c", 0, "text", None, "only text"), ("d", 0, "image", "only.jpg", None)]
    return spark.createDataFrame(rows, "request_id string, pos int, type string, location string, text string")


def test_media_validation_prompt_and_last_image(spark):
    m = _media(spark)
    errs = {(r["request_id"], r["pos"]): r["error"] for r in G.validate_media(m).collect()}
    assert errs[("a", 0)] is None and errs[("a", 1)] is None
    assert errs[("b", 0)] == "media type not supported: image"  # empty location
    assert errs[("b", 1)] == "a text medium holds no text"
    assert errs[("b", 2)] == "media type not supported: audio"
    with pytest.raises(Exception):
        G.validate_media(m, on_invalid="error").collect()
    p = {r["request_id"]: r["prompt_text"] for r in G.assemble_prompt(m, ["request_id"]).collect()}
    assert p["a"] == "What is {x}?" and p["c"] == "only text" and p["d"] == ""
    img = {r["request_id"]: r["image_location"] for r in G.last_image(m, ["request_id"]).collect()}
    assert img == {"a": "img2.jpg", "b": None, "c": None, "d": "only.jpg"}


def test_strip_cut_and_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2, False), ([1, 2], 5, False), ([1, 2, 3], 2, True)],
                               "ids array<int>, n int, echo boolean")
    got = [r[0] for r in df.select(G.strip_prompt("ids", "n", F.col("echo"))).collect()]
    assert got == [[3, 4], [], [1, 2, 3]]
    t = spark.createDataFrame([("<bos>hello world<eos><pad>",), ("a<eos>b<eos>",), ("no end",),
                               ("x<bos>y<eos>",)], "t string")
    out, err = G.cut_at_eos(F.col("t"))
    rows = t.select(out.alias("o"), err.alias("e"), G.token_structs(out).alias("s")).collect()
    assert [r["o"] for r in rows] == ["hello world", "a", None, "xy"]
    assert [r["e"] for r in rows] == [None, None, "substring not found", None]
    assert [(s["text"], s["logprob"]) for s in rows[0]["s"]] == [("hello", 0.0), ("world", 0.0)]
    with pytest.raises(Exception):
        t.select(G.cut_at_eos_strict(F.col("t"))).collect()


def test_memoised_generation_and_results(spark, tmp):
    def _make_gen():  # local, so it is shipped to the workers by value
        def gen(prompt):
            if "boom" in prompt:
                raise RuntimeError("model failed")
            return prompt.upper()
        return gen

    req = spark.createDataFrame([("r1", "hi", 2), ("r2", "boom", 2), ("r3", "hi", 1)],
                                "request_id string, prompt string, num_completions int")
    comp = G.expand_completions(req).withColumn(
        "cache_key", G.cache_key("num_completions", "i", F.lit("m"), G.prompt_uid("prompt")))
    cache = f"{tmp}/cache"
    first = G.memoised_generate(comp, cache, _make_gen)
    rows = {(r["request_id"], r["i"]): r for r in first.collect()}
    assert rows[("r1", 0)]["output"] == "HI" and rows[("r1", 0)]["cached"] is False
    assert rows[("r2", 1)]["error"] == "model failed"
    second_df = G.memoised_generate(comp, cache, _make_gen, pin_input=True)
    second = {(r["request_id"], r["i"]): r for r in second_df.collect()}
    assert second[("r1", 1)]["cached"] is True and second[("r1", 1)]["output"] == "HI"
    assert second[("r2", 0)]["cached"] is False  # errors are never cached
    res = {r["request_id"]: r for r in G.assemble_results(second_df, ["request_id"]).collect()}
    assert res["r1"]["success"] and res["r1"]["cached"] is True
    assert [c["text"] for c in res["r1"]["completions"]] == ["HI", "HI"]
    assert res["r1"]["completions"][0]["tokens"][0]["text"] == "HI"
    assert not res["r2"]["success"] and res["r2"]["completions"] == []
    assert res["r2"]["error"] == "model failed" and res["r2"]["cached"] is False


def test_results_last_completion_flags(spark):
    rows = [("q", 0, "a", None, False, 1.0), ("q", 1, "b", None, True, 2.0),
            ("e", 0, "a", None, True, 1.0), ("e", 1, None, "oops", False, 0.5)]
    df = spark.createDataFrame(rows, "rid string, i int, output string, error string, cached boolean, request_time double")
    res = {r["rid"]: r for r in G.assemble_results(df, ["rid"]).collect()}
    assert res["q"]["cached"] is True and res["q"]["request_time"] == 2.0
    assert res["e"]["success"] is False and res["e"]["error"] == "oops"
    assert res["e"]["request_time"] is None
    reqs = spark.createDataFrame([("q",), ("e",), ("zero",)], "rid string")
    res = {r["rid"]: r for r in G.assemble_results(df, ["rid"], requests=reqs).collect()}
    assert res["zero"]["success"] is True and res["zero"]["completions"] == []
    assert res["zero"]["cached"] is False and res["q"]["cached"] is True


def test_map_rows_and_per_worker(spark):
    calls = []

    def init():
        calls.append(1)
        return {"suffix": "!"}

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = map_rows(df, lambda r, st: {"k": r["k"], "v2": r["v"] + st["suffix"]}, "k int, v2 string", init=init)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a!"), (2, "b!")]
    key = factory_key(init)  # once, as the factory's captured list changes when it runs
    assert per_worker(init, key) is per_worker(init, key)


def test_per_worker_keeps_closures_apart():
    def make(name):
        return lambda: [name]
    a, b = make("A"), make("B")
    assert per_worker(a) == ["A"] and per_worker(b) == ["B"] and per_worker(a) is per_worker(a)


def test_cache_key_fields_cannot_run_together(spark):
    from pyspark.sql import functions as F
    key = lambda a, b: G.cache_key(F.lit(1), F.lit(0), F.lit(a), F.lit(b))
    r = spark.range(1).select(key("a|b", "c").alias("x"), key("a", "b|c").alias("y")).first()
    assert r.x != r.y


def test_cache_key_covers_request_settings(spark):
    df = spark.createDataFrame([(2, 0, "m", "p", 0.0, None), (2, 0, "m", "p", 0.7, None),
                                (2, 0, "m", "p", 0.0, None), (2, 0, "m", "p", None, None)],
                               "n int, i int, model string, prompt string, temperature double, stop string")
    keys = [r[0] for r in df.select(G.cache_key("n", "i", "model", G.prompt_uid("prompt"),
                                                "temperature", "stop")).collect()]
    assert keys[0] == keys[2] and len({keys[0], keys[1], keys[3]}) == 3


def test_batched_generator_with_fallback(spark, tmp):
    def make():
        class Gen:
            def __call__(self, p):
                if p == "bad":
                    raise RuntimeError("bad prompt")
                return p[::-1]

            def batch(self, prompts):
                if "bad" in prompts:
                    raise RuntimeError("batch failed")
                return [p[::-1] for p in prompts]
        return Gen()

    req = spark.createDataFrame([("a", "abc"), ("b", "bad"), ("c", "xy")], "request_id string, prompt string")
    comp = req.withColumn("i", F.lit(0)).withColumn("cache_key", G.prompt_uid("prompt"))
    out = {r["request_id"]: r for r in G.memoised_generate(comp, None, make).collect()}
    assert out["a"]["output"] == "cba" and out["c"]["output"] == "yx"
    assert out["b"]["output"] is None and out["b"]["error"] == "bad prompt"


def test_per_worker_keys_do_not_collide():
    # same module and qualified name, different code: two cache entries
    ns1, ns2 = {}, {}
    exec("def make():\n    return 'one'", ns1)
    exec("def make():\n    return 'two'", ns2)
    assert ns1["make"].__qualname__ == ns2["make"].__qualname__
    assert per_worker(ns1["make"]) == "one" and per_worker(ns2["make"]) == "two"


def test_second_run_opens_only_the_folders_it_asks_for(spark, tmp):
    req = spark.range(300).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"),
                                  F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    make = lambda: (lambda p: p.upper())
    cache = f"{tmp}/cache"
    assert G.memoised_generate(req, cache, make).filter("cached").count() == 0
    few = req.filter("id in (3, 5)")
    keys = {r["cache_key"][:2] for r in few.collect()}
    part = G.read_results(spark, cache, few)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    assert {r["f"].split("bucket=k")[1][:2] for r in part.select(F.input_file_name().alias("f")).collect()} == keys
    hits, misses = G.split_cache(few, part.select("cache_key", "output"))
    assert sorted(r["output"] for r in hits.collect()) == ["P3", "P5"] and misses.count() == 0
    again = G.memoised_generate(few.unionByName(spark.range(1000, 1002).select("id", F.lit("new").alias("prompt"), F.lit("zz").alias("cache_key"))), cache, make)
    assert sorted((r["id"], r["output"], r["cached"]) for r in again.collect()) == [(3, "P3", True), (5, "P5", True), (1000, "NEW", False), (1001, "NEW", False)]
    nothing = f"{tmp}/empty"
    assert G.memoised_generate(req.limit(0), nothing, make).count() == 0
    assert G.memoised_generate(few, nothing, make).count() == 2  # a cache without any file
