"""Question/annotation dataset preparation (P1-P9, J1, L1-L2 wiring).

``build_qa_dataset`` is the flagship: questions joined with annotations,
prompt-formatted, optionally sampled to an exact fraction, tagged with the
split and the image directory, and given each row's image file path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.functions.strings import (
    REFERENCE_PROMPT,
    format_template,
    image_file_name,
    path_join,
)
from vqaframe.operators.sampling import exact_sample

# Fixed values that must equal the reference's: the annotation columns it
# drops before the join and the column it renames to ``answer``.
ANNOTATION_DROP = ["question_type", "answers", "answer_type", "image_id"]
ANNOTATION_RENAME = {"multiple_choice_answer": "answer"}


def strict_drop(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns, failing on the driver if one is missing (pandas rule)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename; a missing source column is ignored, as in both originals."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def join_questions_annotations(questions: DataFrame, annotations: DataFrame,
                               key: str = "question_id",
                               drop: list[str] | None = None,
                               renames: dict[str, str] | None = None,
                               null_safe: bool = False) -> DataFrame:
    """P1 + P2 + J1: many-to-many inner equi-join on ``key``.

    Null keys never match (Spark semantics); ``null_safe=True`` matches them
    to each other as pandas does. The join is left to Catalyst: both sides
    are hash-partitioned on the key, AQE splits skewed keys.
    """
    a = rename(strict_drop(annotations, ANNOTATION_DROP if drop is None else drop),
               ANNOTATION_RENAME if renames is None else renames)
    if not null_safe:
        return questions.join(a, key, "inner")
    a2 = a.withColumnRenamed(key, "_akey")
    return (questions.join(a2, questions[key].eqNullSafe(a2["_akey"]), "inner")
            .drop("_akey"))


def format_questions(df: DataFrame, template: str = REFERENCE_PROMPT,
                     col: str = "question") -> DataFrame:
    """Render every question through the prompt template."""
    return df.withColumn(col, format_template(template, col))


def tag_split(df: DataFrame, split: str, img_path: str) -> DataFrame:
    """P4 + P5: constant ``split`` and ``img_path`` columns."""
    return df.withColumns({"split": F.lit(split), "img_path": F.lit(img_path)})


def with_image_file(df: DataFrame, img_path: str, split: str,
                    image_id_col: str = "image_id", out_col: str = "image_file") -> DataFrame:
    """Directory joined with ``COCO_{split}2014_{zero-padded id}.jpg``."""
    return df.withColumn(out_col, path_join(img_path, image_file_name(F.col(image_id_col), split)))


def build_qa_dataset(questions: DataFrame, annotations: DataFrame, split: str,
                     img_path: str, template: str = REFERENCE_PROMPT,
                     fraction: float | None = None, seed: int = 42,
                     key: str = "question_id", position_col: str = "position") -> DataFrame:
    """The prepared split: join, format, exact sample of the joined rows, tag.

    The sample is taken after the join (``n`` is the joined count) and is
    never pushed below it. The keys of the join are written once for the passes
    that find the sample; ``position_col`` is a sampled row's place in the shuffle.
    """
    joined = format_questions(join_questions_annotations(questions, annotations, key), template)
    if fraction is not None:
        joined = exact_sample(joined, [key], fraction=fraction, seed=seed, pin_keys=True, position_col=position_col)
    return with_image_file(tag_split(joined, split, img_path), img_path, split)


def image_prefix(text, num_patches: int, image_token: str = "<image>"):
    """The image placeholder repeated ``num_patches`` times before the text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.repeat(F.lit(image_token), num_patches), t)


def answer_with_eos(answer, eos_token: str = "<eos>"):
    """The answer followed by the end-of-sequence token."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.concat(a, F.lit(eos_token))
