"""Driver tables mapped onto the data model of the question-answering toolkit.

question/annotation pairs  = documents joined with labels on doc_id
                             (or a user turn and the assistant turn after it)
logits / labels            = embeddings.embedding (64 wide) / embeddings.label
metric lines               = events (``props`` is the junk line of error events)
media objects              = conversations rows (pos = turn)
image ids                  = doc_id / page_id; the image listing comes from pages
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.functions.strings import whitespace_tokens
from vqaframe.session import spread_narrow, table_path

# Parameters of the registered queries; reference values where it has them.
SPLIT = "train"
IMG_DIR = "images/train2014"
TRAIN_P = 0.05           # FSDP train fraction
SAMPLE_P = 0.29          # exact_sample fraction (any p in [0, 1]; reference runs use 0.001-0.10)
EVAL_CAP = 200           # evaluation cap on documents. The reference caps at 2,000; 200
                         # binds on the 1,000 documents at sf0.01 and the 10,000 at sf0.1,
                         # so the cap's selection path is what gets checked
SEED = 42
TEXT_LENGTH = 64
NUM_PATCHES = 257
IMAGE_TOKEN_ID = 256000  # the reference's fixed image token id
EVAL_BATCH = 16
TRAIN_BATCH = 6          # FSDP per-device batch size
NUM_RANKS = 4
NUM_COMPLETIONS = 2
FAILING_WORD = "the"  # prompts with it fail in result_assembly
MODEL = "vqa-model"
EOS_STANDIN = "."        # sentence end plays <eos> on driver prose


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a driver table. ``spread=True`` for queries whose first step is
    heavy per-row work on the scan (tokenising, regex cuts, Python rows);
    where a join or aggregation comes first, its own shuffle spreads the rows."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread_narrow(df) if spread else df


def questions(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("image_id"),
                    F.col("text").alias("question"))


def annotations(spark, sf_dir) -> DataFrame:
    lab = load(spark, sf_dir, "labels")
    q = F.col("quality").cast("string")
    return lab.select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("image_id"),
                      F.lit("quality").alias("question_type"),
                      F.col("toxic").cast("string").alias("answer_type"),
                      q.alias("multiple_choice_answer"),
                      F.array(F.struct(q.alias("answer"))).alias("answers"))


def qa_pairs(spark, sf_dir, spread: bool = False) -> DataFrame:
    """User turn t answered by the assistant turn t+1 of the same conversation.

    Equi-join on (conv_id, turn+1): both keys hash-partition, so a very long
    conversation does not land in one task. ``spread`` for callers doing
    heavy per-row work after the join (it may be a broadcast join, which
    keeps the scan's partitioning).
    """
    c = load(spark, sf_dir, "conversations", spread=spread)
    q = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("_next"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("_next"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "_next"], "inner").drop("_next")


def media(spark, sf_dir) -> DataFrame:
    """Media objects: user text, assistant turn as an image, anything else unknown."""
    c = load(spark, sf_dir, "conversations")
    role = F.col("role")
    mtype = F.when(role == "user", F.lit("text")).when(role == "assistant", F.lit("image")).otherwise(role)
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"),
                    mtype.alias("type"),
                    F.when(role == "assistant", F.col("text")).alias("location"),
                    F.when(role != "assistant", F.col("text")).alias("text"))


def metric_lines(spark, sf_dir) -> DataFrame:
    """(rank, line): error events carry their junk ``props`` as the line."""
    e = load(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return e.select((F.col("user_id") % NUM_RANKS).cast("int").alias("rank"), line.alias("line"))


def tokens(col):
    return whitespace_tokens(col)


def zipped(*cols):
    """Each row's columns as the entries ``<column>.txt`` of a zip archive, as bytes.

    A plain function of one row: an Arrow batch would hold up to 10,000 rows, whatever the size of their texts.
    """
    names = [f"{c}.txt" for c in cols]

    @F.udf("binary", useArrow=False)
    def pack(*texts):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(names, texts, strict=True):
                z.writestr(name, text or "")
        return buf.getvalue()

    return pack(*cols)
