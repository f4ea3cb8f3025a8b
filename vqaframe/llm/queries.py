"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.llm import (fill_middle, license_scan, line_dedup, packing, periodic, quality, secret_scan, sentencepiece_fst,
                          simhash, suffix_dedup, token_count, topk, warc_audit)
from vqaframe.llm.common import BLANK
from vqaframe.session import table_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_count.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_fst.encode(_read(spark, sf_dir, "documents"), model, decoded_col="decoded")
    return out.select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"),
                      (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=50)
    passage_bytes = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),  # U+FFFD where a character was cut apart
                      # beyond the contract's 400 bytes: passages of over 50 words that stand elsewhere too, and the text with one of each
                      F.size("passages").cast("long").alias("n_passages"), passage_bytes.alias("n_passage_bytes"),
                      F.coalesce("once", "row.text", F.lit("")).alias("text_once"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(_read(spark, sf_dir, "documents"), keep_rows=False)
    return rated.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stored replica loses the last character of about one record in 256, chosen by the record's own hash
    record = F.col("record")
    damage = F.when(F.xxhash64("record").bitwiseAND(255) == 0, F.substring(record, F.lit(1), F.char_length("record") - 1)).otherwise(record)
    return warc_audit.audit(_read(spark, sf_dir, "pages"), damage).withColumnRenamed("id", "page_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind_no"] == k)).cast("long")
    rules = F.filter("spans", lambda x: x["kind_no"] < secret_scan.MARKOV)
    return out.select(F.col("id").alias("doc_id"), *[of(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS)],
                      F.sha2(secret_scan.joined_spans(rules), 256).alias("base_sha256"),
                      secret_scan.joined_spans(F.col("spans")).alias("spans"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the periods that the contract of op13 plants in a tenth of the documents."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    trimmed = F.btrim("text", F.lit(BLANK))

    def periodic_words(words):  # a variable of the outer transform, so that the text is split once
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(
            words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

    planted = F.get(F.get(F.transform(F.array(F.split(trimmed, r"[\x20\x09-\x0D]+")), periodic_words), F.lit(0)), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & (trimmed != ""), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic.collapse_runs(docs)
    longest = F.get(F.sort_array(F.transform("runs", lambda x: F.struct(
        (-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period")))), F.lit(0))
    listed = F.concat_ws("", F.transform("runs", lambda x: F.concat(
        F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))))
    return out.withColumn("x", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("x.start").alias("start"),
        (-F.col("x.less")).alias("length"), F.col("x.period").alias("period"),
        F.floor(-1000 * F.col("x.less") / F.col("x.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_scan": op7_license_scan,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
