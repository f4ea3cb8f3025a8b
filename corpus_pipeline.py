"""The training-data pipeline: quality rules, line dedup, SimHash near-dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again as the next stage's ``docs``. All but the last return the columns of
``documents``; a stage that changes texts counts ``n_chars`` anew where that column is there.

SQL cannot express the fingerprints and the tokens, so there is no SQL for ``run``; the tests hold it
against plain Python over a small table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.llm import line_dedup, packing, quality, simhash, suffix_dedup
from vqaframe.llm.common import BLANK, materialise, unpacked
from vqaframe.session import table_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return unpacked(quality.rate_documents(docs).filter("kept"), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one."""
    return unpacked(line_dedup.dedup_lines(docs), docs.columns, text=F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs)


#: Bytes of a passage. A repeat of more than 50 words is at least 51 words and blanks long, in prose about 300 bytes;
#: 200 also finds those with short words, and shorter repeats with them.
PASSAGE_BYTES, PASSAGE_GRAM = 200, 64


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of ``PASSAGE_BYTES`` that occur at several places the first stays, all others go.

    A document whose last word went so is dropped: nothing of it is left to pack.
    """
    cut = suffix_dedup.cut_passages(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, as_text=True, keep_first=True)
    emptied = (F.col("n_removed") > 0) & (F.btrim("kept", F.lit(BLANK)) == "")
    return unpacked(cut.filter(~emptied), docs.columns, text=F.col("kept"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as sequences of at most 1024 tokens."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
