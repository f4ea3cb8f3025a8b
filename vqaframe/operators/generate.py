"""Requests, media prompts, memoised generation and result assembly.

A request has media objects (request_id, pos, type, location, text) and a
number of completions. Generation results are memoised in a Parquet cache
keyed by a hash of (n, i, model, prompt uid): misses are computed once per
distinct key, written first, then joined back, so a non-deterministic
generator cannot give different rows to different actions.
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.functions.arrays import index_range, safe_slice
from vqaframe.functions.strings import whitespace_tokens
from vqaframe.operators.udf import factory_key, per_worker
from vqaframe.session import ensure, literal_frame, path_exists, ship_package, shared_dir

# Media type names and the generation markers of the model.
IMAGE_TYPE = "image"
TEXT_TYPE = "text"
BOS_TOKEN = "<bos>"
EOS_TOKEN = "<eos>"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def expand_completions(df: DataFrame, n_col: str = "num_completions", i_col: str = "i") -> DataFrame:
    """G1: one row per completion index 0..n-1 (n = 0 gives no rows)."""
    return df.withColumn(i_col, F.explode(index_range(n_col)))


def media_error(type_col: str = "type", location_col: str = "location",
                text_col: str = "text"):
    """The reason a media object is invalid, or null when it is valid.

    Text needs a non-null value. An image needs a non-empty location; one
    without it is, like any other type, unrecognised (the original's checks
    fall through to that error).
    """
    t = F.col(type_col)
    has_location = F.coalesce(F.length(location_col), F.lit(0)) > 0
    return (F.when((t == IMAGE_TYPE) & has_location, F.lit(None).cast("string"))
            .when(t == TEXT_TYPE,
                  F.when(F.col(text_col).isNull(),
                         F.lit("a text medium holds no text")))
            .otherwise(F.concat(F.lit("media type not supported: "),
                                F.coalesce(t, F.lit("None")))))


def validate_media(media: DataFrame, type_col: str = "type", location_col: str = "location",
                   text_col: str = "text", on_invalid: str = "quarantine") -> DataFrame:
    """G2 over a media table: adds ``error``; ``on_invalid='error'`` fails the job."""
    out = media.withColumn("error", media_error(type_col, location_col, text_col))
    if on_invalid == "error":
        out = ensure(out, F.col("error").isNull(), F.col("error"))
    elif on_invalid != "quarantine":
        raise ValueError("on_invalid must be 'error' or 'quarantine'")
    return out


def assemble_prompt(media: DataFrame, keys: list[str], pos_col: str = "pos",
                    type_col: str = "type", text_col: str = "text",
                    out_col: str = "prompt_text") -> DataFrame:
    """A5: text pieces of each request concatenated in position order, no separator.

    A request without text pieces gets the empty prompt. One group per
    request, bounded by the request's own media objects.
    """
    is_text = F.col(type_col) == TEXT_TYPE
    piece = F.when(is_text, F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t")))
    s = F.sort_array(F.collect_list(piece))  # collect_list skips the nulls of other types
    return (media.groupBy(*keys).agg(s.alias("_s"))
            .select(*keys, F.array_join(F.transform("_s", lambda x: x["t"]), "").alias(out_col)))


def last_image(media: DataFrame, keys: list[str], pos_col: str = "pos",
               type_col: str = "type", location_col: str = "location",
               out_col: str = "image_location") -> DataFrame:
    """The image at the greatest position wins (later images overwrite)."""
    is_img = (F.col(type_col) == IMAGE_TYPE) & (F.coalesce(F.length(location_col), F.lit(0)) > 0)
    return media.groupBy(*keys).agg(
        F.max_by(F.when(is_img, F.col(location_col)), F.when(is_img, F.col(pos_col))).alias(out_col))


def strip_prompt(ids, input_len, echo_prompt=False):
    """Drop the first ``input_len`` generated ids unless the prompt is echoed."""
    a = _c(ids)
    n = _c(input_len)
    echo = F.lit(echo_prompt) if isinstance(echo_prompt, bool) else _c(echo_prompt)
    return F.when(echo, a).otherwise(safe_slice(a, n + 1, F.size(a) - n))


def cut_at_eos(text, eos_token: str = EOS_TOKEN, bos_token: str = BOS_TOKEN):
    """Text before the first ``eos_token``, markers removed; null when absent.

    Returns (output, error) columns. ``raise_on_missing`` behaviour is
    available through ``cut_at_eos_strict``.
    """
    t = _c(text)
    at = F.locate(eos_token, t)
    cut = F.when(at > 0, F.substring(t, F.lit(1), at - 1))
    out = F.replace(F.replace(cut, F.lit(bos_token), F.lit("")), F.lit(eos_token), F.lit(""))
    err = F.when(t.isNotNull() & (at == 0), F.lit("substring not found"))
    return out, err


def cut_at_eos_strict(text, eos_token: str = EOS_TOKEN, bos_token: str = BOS_TOKEN):
    """G5 with the original's failure: a missing marker fails the task."""
    out, err = cut_at_eos(text, eos_token, bos_token)
    return F.when(err.isNotNull(), F.raise_error(err)).otherwise(out)


def token_structs(text, logprob: float = 0.0):
    """Re-tokenised output as an array of {text, logprob} structs."""
    return F.transform(whitespace_tokens(text),
                       lambda t: F.struct(t.alias("text"), F.lit(logprob).alias("logprob")))


def cache_key(n, i, model, prompt_uid, *request_fields):
    """Sha-256 of (n, i, model, prompt uid, other request fields) in a fixed order.

    Pass the request's other generation settings (temperature, max tokens,
    stop sequences...) as ``request_fields`` so that different settings never
    share a cached result. The fields are written as a JSON array, nulls as
    null, so different fields never give the same key.
    """
    fields = (n, i, model, prompt_uid) + request_fields
    return F.sha2(F.to_json(F.array(*[_c(x).cast("string") for x in fields])), 256)


def prompt_uid(prompt_text, *media):
    """Stable identifier of a prompt's content: its text and the locations of its media, in order."""
    text = F.md5(_c(prompt_text))
    return F.md5(F.to_json(F.array(text, *[_c(m).cast("string") for m in media]))) if media else text


_PREFIX = 2  # hex digits of the key that name a cache folder: 256 of them


def _bucket(key_col: str):
    return F.concat(F.lit("k"), F.substring(key_col, 1, _PREFIX))  # with a letter, so that none reads as a number


def store_results(results: DataFrame, cache_path: str, key_col: str = "cache_key") -> None:
    """Append results to a cache, in folders by the first digits of their key, sorted by key inside."""
    keyed = results.withColumn("bucket", _bucket(key_col))
    keyed.repartition("bucket").sortWithinPartitions("bucket", key_col).write.mode("append").partitionBy("bucket").parquet(cache_path)


def read_results(spark: SparkSession, cache_path: str, asked: DataFrame, key_col: str = "cache_key") -> DataFrame:
    """The part of a cache whose folders hold an asked key.

    The folders asked for (at most 256 short strings) are a filter on the partition column, so no other file is opened.
    """
    buckets = asked.select(_bucket(key_col).alias("b")).distinct().collect()
    schema = f"{key_col} string, output string, request_time double, run_id string, bucket string"
    cache = spark.read.schema(schema).parquet(cache_path)
    return cache.filter(F.col("bucket").isin([r["b"] for r in buckets])).drop("bucket")


def split_cache(completions: DataFrame, cache: DataFrame, key_col: str = "cache_key"):
    """(hits joined with their stored result, distinct missing keys).

    Only keys decide what is missing; a stored result is read for the hits.
    """
    # runs that overlap may have stored a key twice
    hits = completions.join(cache.dropDuplicates([key_col]), key_col, "inner")
    misses = completions.join(cache.select(key_col), key_col, "left_anti")
    return hits, misses.dropDuplicates([key_col])


GEN_SCHEMA = "cache_key string, output string, error string, request_time double"


def _run_generator(make_generator, capture: tuple):
    def one_by_one(gen, columns):
        outs, errs, times = [], [], []
        for asked in zip(*columns, strict=True):
            t0 = time.perf_counter()
            try:
                outs.append(gen(*asked))
                errs.append(None)
            except capture as e:  # the reference captures runtime errors only
                outs.append(None)
                errs.append(str(e))
            times.append(time.perf_counter() - t0)
        return outs, errs, times

    key = factory_key(make_generator)

    def run(batches):
        gen = per_worker(make_generator, key)
        batch_fn = getattr(gen, "batch", None)
        for pdf in batches:
            # text first, then the media; missing values as None
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns[1:]]
            prompts = columns[0]
            result = None
            if batch_fn is not None and prompts:
                t0 = time.perf_counter()
                try:
                    outs = list(batch_fn(*columns))
                    each = (time.perf_counter() - t0) / len(prompts)
                    result = outs, [None] * len(prompts), [each] * len(prompts)
                except capture:  # find the failing prompts one by one
                    result = None
            if result is None:
                result = one_by_one(gen, columns)
            outs, errs, times = result
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "output": outs,
                                "error": errs, "request_time": times})
    return run


def memoised_generate(completions: DataFrame, cache_path: str | None, make_generator,
                      key_col: str = "cache_key", prompt_col: str = "prompt",
                      capture: tuple = (RuntimeError,), pin_input: bool = False,
                      media_cols: tuple = (), partitions: int | None = None) -> DataFrame:
    """G8 + J4: results for every completion row, computing only distinct misses.

    ``make_generator()`` returns ``(prompt, *media) -> text``, with the values
    of ``media_cols`` (image locations, or contents); the cache key must cover
    them (``prompt_uid``). It is built once per Python worker. Misses are dealt
    to ``partitions`` tasks (the shuffle partitions if not given), however few
    bytes they are. If it also has ``batch(prompts, *media) -> texts`` that is called
    once per Arrow batch (a model runs faster on batches); a captured error
    there re-runs that batch prompt by prompt so each request gets its own
    error. Misses are written before they are read back (a run table
    with errors, the cache with successes), so every later action sees the
    same rows. Adds output, error, request_time, cached. The completions
    are used twice (distinct misses, final join); ``pin_input=True`` writes
    them once to the shared folder first, for inputs that are costly to
    recompute.
    """
    spark = completions.sparkSession
    ship_package(spark)
    if pin_input:
        pinned = shared_dir(spark, "generation-input")
        completions.write.parquet(pinned)
        completions = spark.read.parquet(pinned)
    run_id = uuid.uuid4().hex
    if cache_path is not None and path_exists(spark, f"{cache_path}/_SUCCESS"):
        cache = read_results(spark, cache_path, completions, key_col)
    else:  # first run: an empty cache
        cache = literal_frame(spark, [], [(key_col, "string"), ("output", "string"),
                                          ("request_time", "double"), ("run_id", "string")])
    hits, misses = split_cache(completions, cache.select(key_col, "output", "request_time"), key_col)
    todo = (misses.select(F.col(key_col).alias("cache_key"), F.col(prompt_col).alias("prompt"), *media_cols)
            .repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "cache_key"))
    produced = todo.mapInPandas(_run_generator(make_generator, capture), GEN_SCHEMA)
    run_dir = shared_dir(spark, "generation-run")
    produced.write.mode("overwrite").parquet(run_dir)
    run = spark.read.parquet(run_dir).withColumnRenamed("cache_key", key_col)
    if cache_path is not None:
        store_results(run.filter(F.col("error").isNull()).select(key_col, "output", "request_time", F.lit(run_id).alias("run_id")),
                      cache_path, key_col)
    old = hits.withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)})
    new = run.select(key_col, "output", "request_time", "error", F.lit(False).alias("cached"))
    return old.unionByName(completions.join(new, key_col))


def assemble_results(completions: DataFrame, keys: list[str], i_col: str = "i",
                     output_col: str = "output", error_col: str = "error",
                     cached_col: str = "cached", time_col: str = "request_time",
                     requests: DataFrame | None = None) -> DataFrame:
    """A8 + G9: one result per request.

    Completions in index order; ``cached`` and ``request_time`` from the last
    completion; any captured error makes the request unsuccessful with no
    completions and the first error message. Pass ``requests`` (with the key
    columns) to also return requests that asked for zero completions: they
    succeed with an empty list.
    """
    err = F.col(error_col)
    s = F.sort_array(F.collect_list(F.struct(F.col(i_col).alias("i"), F.col(output_col).alias("o"))))
    g = completions.groupBy(*keys).agg(
        s.alias("_s"),
        F.bool_and(err.isNull()).alias("success"),
        F.min_by(F.when(err.isNotNull(), err), F.when(err.isNotNull(), F.col(i_col))).alias("_err"),
        F.max_by(cached_col, i_col).alias("_cached"),
        F.max_by(time_col, i_col).alias("_time"))
    comp = F.transform("_s", lambda x: F.struct(x["o"].alias("text"), F.lit(0.0).alias("logprob"),
                                                 token_structs(x["o"]).alias("tokens")))
    if requests is not None:
        g = requests.select(*keys).join(g, list(keys), "left").withColumn(
            "success", F.coalesce("success", F.lit(True)))
    return g.select(
        *keys, "success",
        F.when(F.col("success"), F.coalesce("_cached", F.lit(False))).otherwise(F.lit(False))
        .alias("cached"),
        F.when(~F.col("success"), F.col("_err")).alias("error"),
        F.when(F.col("success"), F.col("_time")).alias("request_time"),
        F.when(F.col("success") & F.col("_s").isNotNull(), comp).otherwise(F.array().cast(
            "array<struct<text:string,logprob:double,tokens:array<struct<text:string,logprob:double>>>>"))
        .alias("completions"))
