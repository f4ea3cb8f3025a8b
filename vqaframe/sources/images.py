"""Image files, and the row -> image lookup (archives: see ``archives``).

Image bytes never travel through a join: rows are matched to the file
listing on the path (path and length only), and ``content`` is re-attached
only when a decoder needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.session import ensure


def scan_images(spark: SparkSession, directory: str, pattern: str = "*.jpg",
                with_content: bool = False, recursive: bool = True) -> DataFrame:
    """Listing of image files: file_name, path, uri, length (+ content). A plain file's uri is its path."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", str(recursive).lower()).load(directory))
    cols = [F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", F.col("path").alias("uri"), "length"]
    if with_content:
        cols.append("content")
    return df.select(*cols)


def archived_images(entries: DataFrame, with_content: bool = False) -> DataFrame:
    """S5 + S6: the same listing of archived images (``expand_archives``), readable ones only.

    ``path`` is where the entry would lie if its archive were unpacked in its own folder, so rows are matched by
    full path in either case; ``uri`` is ``archive!/entry`` and names the bytes.
    """
    folder = F.regexp_replace("archive", r"/?[^/]*$", "")
    ok = entries.filter(F.col("error").isNull())
    listing = ok.select(F.regexp_extract("entry", r"([^/]+)$", 1).alias("file_name"),
                        F.concat(folder, F.lit("/"), F.col("entry")).alias("path"),
                        F.concat(F.col("archive"), F.lit("!/"), F.col("entry")).alias("uri"), "length",
                        *(["content"] if with_content else []))
    return listing


def _plain_path(c):
    """A path as it compares: without the scheme of local files, single slashes."""
    bare = F.regexp_replace(c, r"^file:(//)?(?=/)", "")
    return F.regexp_replace(bare, r"(?<!:)/{2,}", "/")


def attach_images(rows: DataFrame, files: DataFrame, file_col: str = "image_file",
                  on_missing: str = "error", name_col: str = "file_name") -> DataFrame:
    """Match each row to its image by base name, or with ``name_col="path"`` by full path.

    Adds ``image_uri``, which names the bytes whether the image is a plain file or an archive's entry, and
    ``image_bytes``. A name that several listed files share fails the job, as it would not tell which one is meant.

    ``on_missing``: 'error' fails the job on the first row without a file,
    'drop' keeps matched rows only, 'null' keeps every row.
    """
    same = _plain_path if name_col == "path" else (lambda c: c)
    if "uri" not in files.columns:  # plain files only
        files = files.withColumn("uri", F.col("path"))
    listing = files.groupBy(same(F.col(name_col)).alias("_listed_name")).agg(
        F.min("uri").alias("image_uri"), F.min_by("length", "uri").alias("image_bytes"), F.max("uri").alias("_other"))
    listing = ensure(listing, F.col("image_uri") == F.col("_other"),
                     F.concat(F.lit("several files are named "), F.col("_listed_name"))).drop("_other")
    j = rows.join(listing, same(F.col(file_col)) == listing["_listed_name"], "left").drop("_listed_name")
    if on_missing == "drop":
        return j.filter(F.col("image_uri").isNotNull())
    if on_missing == "null":
        return j
    if on_missing == "error":
        return ensure(j, F.col("image_uri").isNotNull(), F.concat(F.lit("image not found: "), F.col(file_col)))
    raise ValueError("on_missing must be 'error', 'drop' or 'null'")


def attach_content(rows: DataFrame, files_with_content: DataFrame,
                   uri_col: str = "image_uri") -> DataFrame:
    """Re-attach image bytes to already matched rows, for a decoder.

    Matching (``attach_images``) moves only path and length. Bytes join in
    here, after rows were selected, sampled or filtered: one shuffle of the
    content of the images still needed. ``files_with_content`` is
    ``scan_images(..., with_content=True)`` or ``archived_images(..., with_content=True)``.
    """
    c = files_with_content.select(F.col("uri").alias("_content_uri"), "content")
    return rows.join(c, rows[uri_col] == c["_content_uri"], "left").drop("_content_uri")


def missing_images(rows: DataFrame, listing: DataFrame, file_col: str = "image_file",
                   name_col: str = "file_name") -> DataFrame:
    """J2 report: rows whose image file is absent from the listing (left anti join)."""
    return rows.join(listing.select(F.col(name_col).alias(file_col)), file_col, "left_anti")
