"""One prepared split, end to end: archive -> JSON records -> joined, formatted,
sampled rows -> image lookup -> Parquet.

This is the dataset job the original meant to run on Spark, with its
defects fixed (keyword arguments, records exploded before the join, a real
rename, no driver collect).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vqaframe.functions.strings import REFERENCE_PROMPT
from vqaframe.operators.prepare import build_qa_dataset
from vqaframe.sources.archives import expand_archives
from vqaframe.sources.dataset_io import load_or_build
from vqaframe.sources.images import archived_images, attach_images, scan_images
from vqaframe.sources.nested_json import read_annotations, read_questions


def prepare_split(spark: SparkSession, annotations_path, questions_path, save_path: str,
                  split: str, img_path: str, archive: bool = False,
                  template: str = REFERENCE_PROMPT, fraction: float | None = None,
                  seed: int = 42, on_missing: str = "error", load: bool = False) -> DataFrame:
    """Build (or reuse) the prepared split and return it as read from ``save_path``.

    Rows carry question_id, image_id, question (formatted), answer, split,
    img_path, image_file, and the matched image's uri and size.
    """
    def build() -> DataFrame:
        if archive:  # a missing archive or an unsafe entry name is reported by the listing, not fatal
            listing = archived_images(expand_archives(spark, [img_path.rstrip("/") + ".zip"]).drop("content"))
        else:
            listing = scan_images(spark, img_path)
        ds = build_qa_dataset(read_questions(spark, questions_path),
                              read_annotations(spark, annotations_path),
                              split, img_path, template=template, fraction=fraction, seed=seed)
        return attach_images(ds, listing, on_missing=on_missing, name_col="path")

    return load_or_build(spark, save_path, build, load=load, partition_by=["split"])


def get_dataset(spark: SparkSession, annotations_path, questions_path,
                prompt: str = REFERENCE_PROMPT, p: float = 1.0, seed: int = 42,
                split: str | None = None, img_path: str | None = None) -> DataFrame:
    """The reference's dataset builder with its signature: JSON files in,
    joined, prompt-formatted rows out, exactly ``int(p * n)`` of them in a
    seeded shuffle order. ``split`` / ``img_path`` add the tag columns the
    training script adds afterwards.
    """
    from vqaframe.operators.prepare import format_questions, join_questions_annotations, tag_split
    from vqaframe.operators.sampling import exact_sample
    joined = join_questions_annotations(read_questions(spark, questions_path),
                                        read_annotations(spark, annotations_path))
    ds = exact_sample(format_questions(joined, prompt), ["question_id"], fraction=p, seed=seed)
    if split is not None:
        ds = tag_split(ds, split, img_path or "")
    return ds
