"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Method: fixed cut-offs give way to thresholds read from mergeable quantile sketches, one for each
language and source, and the documents are filtered by a join with those thresholds.

The sketch of a metric is a log-linear histogram of a whole number: values below 64 have a bucket
each, larger ones 32 buckets per doubling (relative error at most 1/32). Bucket counts add up, so
sketches merge exactly, in any order, before and after the shuffle, and a hot source costs one row per
bucket and task. ``rollup`` merges the sketches of a source into its language's and all languages'.

A document that passes the base rules is rejected when a metric lies beyond its group's fence, read from the upper
part of the sketch: 85 % quantile + reach * max(85 % quantile - median, floor), and for the word length the mirrored
lower fence too. So a group whose documents commonly repeat words gets a laxer limit for that. The quantile stays put
while less than 15 % of a group is junk; the floors keep a group of equal documents from rejecting a slight deviation.
A group with fewer than ``min_group`` documents takes the fences of its language, and a small language those of all
documents.

Defined results: a null text has no words and fails the base rules; null language or source is a group
of its own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import BLANK, UPPER, materialise, packed

SYMBOLS = "#*$%&|<>"
#: metric -> (numerator, denominator, scale, floor in scaled units, reach, has a lower fence)
METRICS = {
    "word_length": ("word_chars", "n_words", 1000, 250, 6, True),
    "symbols": ("n_symbols", "n_words", 10000, 40, 25, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10000, 240, 25, False),
    "repeat_words": ("n_repeat_words", "n_words", 10000, 50, 50, False),
    "upper": ("n_upper", "word_chars", 10000, 40, 25, False),
}
TAIL = 15  # per cent of a group beyond the quantiles that set its fences


def _stripped(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_upper."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANK))
    a = df.withColumn("_body", body).withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))).withColumn(
        "_lines", F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    b = a.withColumn("_hashes", F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.xxhash64(F.get(F.col("_words"), i), F.get(F.col("_words"), i + 1),
                                         F.get(F.col("_words"), i + 2)))))
    # windows by hash; equal ones are neighbours. Texts without a repeated window skip the sort
    c = b.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, j: F.coalesce(F.get(F.col("_sorted"), j)["h"] == s["h"], F.lit(False))
    d = c.withColumn("_starts", F.sort_array(F.transform(
        F.filter("_sorted", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])))
    reach = F.transform("_starts", lambda x, j: F.least(
        F.lit(3), F.coalesce(F.get(F.col("_starts"), j + 1) - x, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0), lambda s, x: s + x)
    size = F.char_length("_body")
    return d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": _stripped(F.col("_body"), BLANK).cast("long"),
        "n_symbols": (size - _stripped(F.col("_body"), SYMBOLS)).cast("long"),
        "n_upper": (size - _stripped(F.col("_body"), UPPER)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_body", "_words", "_lines", "_hashes", "_sorted", "_starts")


def base_failed(min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def metric(name: str) -> Column:
    over, under, scale, *_ = METRICS[name]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * scale / F.col(under))).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number >= 0."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def bucket_top(code: Column) -> Column:
    """Largest value of a bucket."""
    e = F.greatest(F.floor(code / 32) - 1, F.lit(0))
    return ((code - e * 32 + 1) * F.pow(F.lit(2.0), e) - 1).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """Bucket counts of every metric by (lang, source), by lang and overall: level 0, 1 and 3."""
    long = stats.filter(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bucket")) for m in METRICS])).alias("x"))
    fine = (long.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(3).alias("level"), F.lit(None).cast("string").alias("lang"),
                 F.lit(None).cast("string").alias("source"))))
    return (fine.withColumn("g", levels).groupBy(F.col("g.level").alias("level"), F.col("g.lang").alias("lang"),
                                                 F.col("g.source").alias("source"), "metric", "bucket")
            .agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per group and level: its documents and, for every metric, the lower and upper fence.

    A group's buckets form one array: their number is bounded by the sketch (32 per doubling).
    """
    g = (sketch.groupBy("level", "lang", "source", "metric")
         .agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b")))

    def quantile(percent: int) -> Column:
        rank = F.ceil(F.col("docs") * percent / 100)
        found = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
                            lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(
                                s["at"], F.when(s["seen"] + x["n"] >= rank, x["bucket"])).alias("at")))
        return bucket_top(found["at"])

    g = g.withColumns({"least": quantile(TAIL), "middle": quantile(50), "most": quantile(100 - TAIL)})
    of = lambda k: F.create_map(*[F.lit(y) for m, x in METRICS.items() for y in (m, x[k])])[F.col("metric")]
    g = g.withColumns({"high": F.col("most") + of(4) * F.greatest(F.col("most") - F.col("middle"), of(3)),
                       "low": F.col("least") - of(4) * F.greatest(F.col("middle") - F.col("least"), of(3))})
    return g.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[
        F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in METRICS for c in ("low", "high")])


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source", min_group: int = 100, keep_rows: bool = True) -> DataFrame:
    """One row per document: ``row`` (the input, if ``keep_rows``), ``id``, the statistics, ``base_failed``, ``kept``.

    Statistics are computed once and written to the shared folder; sketches and the filter read them.
    """
    base = packed(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    if not keep_rows:
        base = base.drop("row")
    base = base.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    stats = materialise(text_statistics(base).drop("text").withColumn("base_failed", base_failed()), "quality-stats")

    table = materialise(fences(sketches(stats)), "quality-fences")
    cols = [f"{c}_{m}" for m in METRICS for c in ("low", "high")]
    at = lambda level, name: table.filter((F.col("level") == level) & (F.col("docs") >= min_group)).select(
        F.col("lang").alias(f"l{name}"), F.col("source").alias(f"s{name}"), F.struct(*cols).alias(name))
    own, lang = at(0, "own"), at(1, "by_lang")
    top = table.filter(F.col("level") == 3).select(*cols).first()  # one row, as literals
    every = F.struct(*[F.lit(top[c] if top else None).cast("long").alias(c) for c in cols])
    # a group's fences, chosen on the small table of groups; then one join with the documents
    groups = table.filter(F.col("level") == 0).select("lang", "source")
    groups = (groups.join(own, F.col("lang").eqNullSafe(F.col("lown")) & F.col("source").eqNullSafe(F.col("sown")), "left")
              .join(lang, F.col("lang").eqNullSafe(F.col("lby_lang")), "left")
              .select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
                      F.coalesce("own", "by_lang", every).alias("fence")))
    groups = materialise(groups, "quality-groups")
    joined = stats.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) &
                        F.col("source").eqNullSafe(F.col("g_source")), "left")
    outside = F.lit(False)
    for m, (*_, lower) in METRICS.items():
        outside = outside | (metric(m) > F.col(f"fence.high_{m}"))
        if lower:
            outside = outside | (metric(m) < F.col(f"fence.low_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).drop(
        "g_lang", "g_source", "fence", "lang", "source")
