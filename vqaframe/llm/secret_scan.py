"""Secret scans (native: DataFrame functions only).

Base rules find secrets by their form: values assigned to a telling name, access keys, long hex strings. The
method adds strings that no rule names: maximal runs of ``ALPHABET`` characters (``min_chars`` or more, a letter
among them) outside the base spans, judged by two character Markov models.

Method: one first-order model of random strings and one of ordinary identifiers, compared by the log-likelihood
ratio of a run's transitions, in thousandths of a nat; a run at or over ``min_llr`` is a span of kind ``markov``. Both are
trained from labelled samples: random are the distinct values that the base rules find in all documents, ordinary the
distinct runs of at least 6 characters with a letter in ``sample_docs`` documents (those with the least md5 of
their id), read with base matches blanked. A caller may pass labelled strings of their own. Transitions are smoothed by
``smoothing`` for each pair, so without any sample both are uniform and nothing is added.

Every text is read once, in place. A match's place follows from the lengths of the matches and of the gaps
between them, summed by a window over the document's matches; only matches and document keys are shuffled. The
driver sees one row: the table of transitions, whose size the alphabet fixes.

Leftmost greedy matching makes maximal runs of ``[0-9a-f]+`` and ``AKIA[A-Z0-9]+``; shorter ones drop, so they
are matched with their least length at once. Assignments are matched whole and then dropped by length.

Defined results: positions count code points; a null or empty text has no spans; an assignment's span is the whole
match, name included; repeated rows (equal id and text) get the same spans each; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.llm.common import materialise

# The base rules.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
MARKOV = len(KINDS)


def _items(text: Column, hits: Column, pattern: str, kind: int, value=None) -> Column:
    """(kind, number, characters before it since the last match, characters, value) of each match."""
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(hits) > 0, F.transform(
        F.arrays_zip(hits.alias("m"), F.slice(gaps, 1, F.size(hits)).alias("gap"), (hits if value is None else value).alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).cast("long").alias("skip"),
                              F.char_length(x["m"]).cast("long").alias("chars"), x["value"].alias("value"))))


def find_matches(base: DataFrame, min_chars: int) -> DataFrame:
    """One row per document: id, version, items (all matches of the base rules, and the candidate runs)."""
    text = F.col("text")
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", f"{_RUN}{{{min_chars},}}")):
        base = base.withColumn(name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    kinds = [_items(text, F.col("assign"), ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
             _items(text, F.col("access"), ACCESS, 1), _items(text, F.col("hex"), HEX, 2),
             _items(text, F.col("run"), f"{_RUN}{{{min_chars},}}", MARKOV)]
    none = F.array().cast("array<struct<kind: int, i: int, skip: bigint, chars: bigint, value: string>>")
    return base.select("id", "version", F.concat(*[F.coalesce(k, none) for k in kinds]).alias("items"))


def _passes(kind: Column, value: Column) -> Column:
    return (kind < MARKOV) & ((kind != 0) | (F.char_length(value) >= MIN_VALUE))


def labelled_samples(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(value, random): the distinct secrets of the base rules, and the distinct identifiers of the sampled documents."""
    secrets = found.select(F.explode("items").alias("x")).filter(_passes(F.col("x.kind"), F.col("x.value")))
    key = F.md5(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(key.alias("key"), docs[f"`{text_col}`"].alias("text"))
    last = keyed.select("key").orderBy("key").limit(sample_docs).agg(F.max("key")).first()[0]
    text = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    runs = keyed.filter(F.col("key") <= F.lit(last)).select(
        F.explode(F.regexp_extract_all(text, F.lit(f"{_RUN}{{6,}}"), F.lit(0))).alias("value"))
    return (secrets.select(F.col("x.value").alias("value"), F.lit(True).alias("random")).distinct()
            .unionByName(runs.filter(F.col("value").rlike("[A-Za-z]")).select("value", F.lit(False).alias("random")).distinct()))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def transition_scores(samples: DataFrame, smoothing: float) -> str:
    """Log-likelihood ratio of every pair of characters, in thousandths of a nat, comma-joined: pair a * size + b."""
    size = len(ALPHABET)
    codes = samples.select("random", _codes(F.col("value")).alias("c"))
    pairs = codes.select("random", F.explode(F.transform("c", lambda a, i: F.struct(
        a.alias("a"), F.get(F.col("c"), i + 1).alias("b")))).alias("p")).select("random", "p.a", "p.b")
    counts = pairs.filter((F.col("a") >= 0) & (F.col("b") >= 0)).groupBy("a", "b").agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o"))
    every = samples.sparkSession.range(size * size).select(
        F.col("id").alias("pair"), F.floor(F.col("id") / size).cast("int").alias("a"), (F.col("id") % size).cast("int").alias("b"))
    full = every.join(counts, ["a", "b"], "left").na.fill(0, ["r", "o"])
    of_a = Window.partitionBy("a")
    p = [(F.col(x) + smoothing) / (F.sum(x).over(of_a) + smoothing * size) for x in ("r", "o")]
    scored = full.select("pair", F.round(1000 * (F.log(p[0]) - F.log(p[1]))).cast("int").cast("string").alias("score"))
    return scored.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", "score"))), lambda x: x["score"]),
                                   ",")).first()[0]


def likelihood_ratio(value: Column, scores: str) -> Column:
    """Sum of the transition scores of a string."""
    table = F.split(F.lit(scores), ",").cast("array<int>")
    total = F.transform(F.array(_codes(value)), lambda c: F.aggregate(  # the string is split once
        F.transform(c, lambda a, i: a * len(ALPHABET) + F.get(c, i + 1)), F.lit(0).cast("long"),
        lambda s, i: s + F.coalesce(F.get(table, i), F.lit(0))))
    return F.get(total, F.lit(0))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 16,
                 min_llr: int = 10_000, sample_docs: int = 2000, smoothing: float = 1.0,
                 samples: DataFrame | None = None) -> DataFrame:
    """One row per document: ``id``, ``spans`` (array of start, kind_no, end, kind, llr by start, then kind).

    ``samples``: labelled strings (value, random) to train on in place of the corpus's own.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    found = materialise(find_matches(base, min_chars), "secret-matches")
    if samples is None:
        samples = labelled_samples(docs, found, id_col, text_col, sample_docs)
    scores = transition_scores(samples, smoothing)

    # one copy of equal documents; all windows below keep this partitioning
    once = found.filter(F.size("items") > 0).groupBy("id", "version").agg(F.first("items").alias("items"))
    items = once.select("id", "version", F.explode("items").alias("x")).select("id", "version", "x.*")
    so_far = F.sum(F.col("skip") + F.col("chars")).over(Window.partitionBy("id", "version", "kind").orderBy("i"))
    placed = items.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("chars"))
    placed = placed.filter(_passes(F.col("kind"), F.col("value")) | ((F.col("kind") == MARKOV) & F.col("value").rlike("[A-Za-z]")))
    in_text = Window.partitionBy("id", "version").orderBy("start")
    rule = F.col("kind") < MARKOV
    before = F.max(F.when(rule, F.col("end"))).over(in_text.rangeBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(rule, F.col("start"))).over(in_text.rangeBetween(0, Window.unboundedFollowing))
    placed = placed.withColumns({"before": before, "behind": behind})
    apart = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end"))
    scored = placed.filter(rule | apart).withColumn("llr", F.when(~rule, likelihood_ratio(F.col("value"), scores)))
    kind = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "markov")]), F.col("kind") + 1)
    spans = scored.filter(rule | (F.col("llr") >= min_llr)).groupBy("id", "version").agg(F.sort_array(F.collect_list(
        F.struct("start", F.col("kind").alias("kind_no"), "end", kind.alias("kind"), "llr"))).alias("spans"))  # of one text
    spans = spans.select(F.col("id").alias("s_id"), F.col("version").alias("s_version"), "spans")
    joined = found.select("id", "version").join(
        spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("version") == F.col("s_version")), "left")
    return joined.select("id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
