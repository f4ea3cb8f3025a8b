"""Vocabulary, tokenisation and text-pair encoding.

An encoded example is one row with one array per field. Token ids are looked up inside the row (see
``lookup``): the vocabulary travels once with the plan if its checked size allows, so encoding and decoding
move no rows across the network and explode nothing. The ``..._long`` forms are an explosion of the arrays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.functions.strings import whitespace_tokens
from vqaframe.operators.lookup import MAX_BYTES, MAX_ROWS, fits, look_up
from vqaframe.operators.rowindex import with_row_index
from vqaframe.operators.udf import factory_key, per_worker
from vqaframe.session import literal_frame, reliable_checkpoint, ship_package

# Special tokens and ids of the language model's vocabulary,
# the image placeholder, the ignored-label sentinel.
SPECIAL_TOKENS = ["<pad>", "<eos>", "<bos>", "<unk>"]
PAD_ID, EOS_ID, BOS_ID, UNK_ID = 0, 1, 2, 3
IMAGE_TOKEN = "<image>"
IGNORE_INDEX = -100
# Fixed value: the language model's vocabulary ends where the image placeholder's id begins.
VOCAB_SIZE = 256_000


def context_length(text_length: int, num_patches: int) -> int:
    """Tokens per encoded example = text tokens + image patches."""
    if text_length < 0 or num_patches < 0:
        raise ValueError("text_length and num_patches must be >= 0")
    return text_length + num_patches


def sized_broadcast(df: DataFrame, max_rows: int = MAX_ROWS,
                    max_bytes: int = MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring it (see ``lookup.fits``).

    Above either bound the caller gets a plain DataFrame and Spark plans a
    shuffle join (AQE splits hot keys).
    """
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def build_vocab(texts: DataFrame, text_col: str = "text",
                specials: list[str] = SPECIAL_TOKENS, min_count: int = 1,
                max_size: int | None = VOCAB_SIZE) -> DataFrame:
    """T1 vocabulary: specials first, then words by (count desc, token), at most ``max_size`` in all.

    Counting uses map-side partial aggregation, so a very frequent token
    costs one row per partition in the shuffle. Ids come from the
    distributed row index, never from a one-task window.
    """
    spark = texts.sparkSession
    counts = (texts.select(F.explode(whitespace_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
              .filter((F.col("cnt") >= min_count) & ~F.col("token").isin(specials)))
    words = with_row_index(counts, [F.desc("cnt"), F.asc("token")], "_r")
    if max_size is not None:
        words = words.filter(F.col("_r") < max_size - len(specials))
    words = words.select("token", (F.col("_r") + len(specials)).cast("int").alias("id"))
    fixed = literal_frame(spark, [(t, i) for i, t in enumerate(specials)],
                          [("token", "string"), ("id", "int")])
    # pinned in the shared folder: the size check, id lookups and the joins
    # that follow read it instead of recomputing the ranking
    return reliable_checkpoint(fixed.unionByName(words))


def extend_vocab(vocab: DataFrame, token: str = IMAGE_TOKEN) -> DataFrame:
    """Add ``token`` with id = max(id) + 1 unless it is already present."""
    new = (vocab.agg((F.max("id") + 1).cast("int").alias("id"),
                     F.max((F.col("token") == token).cast("int")).alias("_has"))
           .filter(F.coalesce(F.col("_has"), F.lit(0)) == 0)
           .select(F.lit(token).alias("token"), F.coalesce("id", F.lit(0)).alias("id")))
    return vocab.unionByName(new)


def token_id(vocab: DataFrame, token: str) -> int:
    """Id of one token (a single-row lookup)."""
    row = vocab.filter(F.col("token") == token).select("id").first()
    if row is None:
        raise KeyError(f"{token} not in vocabulary")
    return int(row["id"])


def tokens_long(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per (keys, pos, token) from the whitespace tokenizer."""
    return df.select(*keys, F.posexplode(whitespace_tokens(text_col)).alias("pos", "token"))


def lookup_ids(df: DataFrame, vocab: DataFrame, token_col: str = "token",
               out_col: str = "token_id", unk_id: int = UNK_ID,
               max_broadcast: int = MAX_ROWS) -> DataFrame:
    """Token -> id; unknown tokens get ``unk_id``.

    Broadcast hash join when the vocabulary is within ``max_broadcast`` rows;
    above that a shuffle join, where AQE splits hot tokens.
    """
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_id"))
    if fits(vocab, max_broadcast):
        v = F.broadcast(v)
    return (df.join(v, df[token_col] == v["_tok"], "left")
            .withColumn(out_col, F.coalesce(F.col("_id"), F.lit(unk_id)).cast("int"))
            .drop("_tok", "_id"))


def token_ids(df: DataFrame, keys: list[str], text_col: str, vocab: DataFrame, out_col: str = "ids",
              unk_id: int = UNK_ID, max_broadcast: int = MAX_ROWS) -> DataFrame:
    """T1 + J3: the whole text's ids as one array per row; unknown tokens get ``unk_id``, null texts null."""
    return look_up(df, keys, {out_col: whitespace_tokens(text_col)}, vocab, "token", "id", F.lit(unk_id),
                        max_broadcast)


def decode_ids(df: DataFrame, keys: list[str], ids_col: str, vocab: DataFrame, out_col: str = "text", sep: str = " ",
               unk_token: str = "<unk>", max_broadcast: int = MAX_ROWS) -> DataFrame:
    """An array of ids -> text, tokens in order joined by ``sep``; the order never leaves the row."""
    found = look_up(df, keys, {"_tokens": F.col(ids_col)}, vocab, "id", "token", F.lit(unk_token), max_broadcast)
    return found.withColumn(out_col, F.array_join("_tokens", sep)).drop("_tokens")


def _pair_lengths(la, lb, L: int):
    """T3 longest-first truncation lengths (ka, kb) for sequence lengths la, lb."""
    s = F.least(la, lb)
    l1 = F.when(s > L, s).otherwise(F.greatest(s, F.lit(L) - s))
    both = (s + l1) > L
    s2 = F.when(both, F.lit(L // 2)).otherwise(s)
    l2 = F.when(both, F.lit(L - L // 2)).otherwise(l1)
    fits = (la + lb) <= L
    ka = F.when(fits, la).when(la <= lb, s2).otherwise(l2)
    kb = F.when(fits, lb).when(la <= lb, l2).otherwise(s2)
    return ka, kb


def _check(padding_side: str, L: int, sa: int) -> None:
    if padding_side not in ("right", "left"):
        raise ValueError("padding_side must be 'right' or 'left'")
    if L < 2 * sa:
        raise ValueError("context too short for the special tokens")


FIELDS = ["input_id", "token_type", "attention_mask", "label"]


def encode_pairs(df: DataFrame, keys: list[str], vocab: DataFrame,
                 question_col: str = "question", answer_col: str = "answer",
                 text_length: int = 64, num_patches: int = 257,
                 image_token_id: int | None = None, pad_id: int = PAD_ID,
                 eos_token: str = "<eos>", unk_id: int = UNK_ID,
                 padding_side: str = "right", ignore_index: int = IGNORE_INDEX,
                 add_bos: bool = False, bos_id: int = BOS_ID,
                 max_broadcast: int = MAX_ROWS) -> DataFrame:
    """T2-T5 (+P8, P9): training encoding, one row per example: keys and the arrays
    ``input_id``, ``token_type``, ``attention_mask`` and ``label``.

    Sequence A = ``num_patches`` image tokens + question tokens (type 0),
    sequence B = answer tokens + ``<eos>`` (type 1); longest-first
    truncation to L = text_length + num_patches, padding to L with mask 0,
    labels = input id where type is 1, else ``ignore_index``.
    ``add_bos`` puts ``<bos>`` before each sequence, as a tokenizer with a
    pair template does; truncation then works within L - 2.
    """
    train = df.select(*keys, question_col, F.coalesce(answer_col, F.lit("")).alias(answer_col))
    return encode_routed(train, keys, vocab, question_col, answer_col, text_length, num_patches, image_token_id, pad_id,
                         eos_token, unk_id, padding_side, ignore_index, add_bos, bos_id, max_broadcast).drop("mode")


def encode_pairs_long(df: DataFrame, keys: list[str], vocab: DataFrame, *args, **options) -> DataFrame:
    """``encode_pairs`` (same options) in long form, one row per (keys, pos)."""
    return positions(encode_pairs(df, keys, vocab, *args, **options), keys)


def user_token_ids(text, make_tokenizer, return_type: str = "array<int>"):
    """T1 with a user tokenizer: a column of token ids from ``make_tokenizer()``.

    ``make_tokenizer()`` returns an object with ``encode_batch(texts) ->
    list of id lists`` (or a callable ``text -> ids``). It is built once per
    Python worker; texts arrive in Arrow batches (pandas UDF), so a fast
    tokenizer sees whole batches. Null text gives null ids.
    """
    ship_package(SparkSession.getActiveSession())

    key = factory_key(make_tokenizer)

    @F.pandas_udf(return_type)
    def _ids(texts: pd.Series) -> pd.Series:
        tok = per_worker(make_tokenizer, key)
        mask = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if mask.any():
            batch = list(texts[mask])
            encode = getattr(tok, "encode_batch", None)
            ids = encode(batch) if encode is not None else [tok(t) for t in batch]
            out[mask] = pd.Series([list(x) for x in ids], index=texts[mask].index, dtype=object)
        return out

    return _ids(F.col(text) if isinstance(text, str) else text)


def encode_pair_ids(df: DataFrame, keys: list[str], question_ids: str, answer_ids: str,
                    text_length: int = 64, num_patches: int = 257,
                    image_token_id: int = 256000, eos_id: int = EOS_ID, pad_id: int = PAD_ID,
                    padding_side: str = "right", ignore_index: int = IGNORE_INDEX,
                    add_bos: bool = False, bos_id: int = BOS_ID) -> DataFrame:
    """T2-T5 for already tokenised pairs, one row per example: keys and the arrays
    ``input_id``, ``token_type``, ``attention_mask`` and ``label``, each L long.

    Same layout, truncation, padding and labels as ``encode_pairs``.
    ``<eos>`` is appended to the answer ids; null ids are treated as empty.
    """
    none = F.array().cast("array<int>")
    base = df.select(*keys, F.coalesce(F.col(question_ids).cast("array<int>"), none).alias("_q"),
                     F.concat(F.coalesce(F.col(answer_ids).cast("array<int>"), none), F.array(F.lit(eos_id))).alias("_b"))
    base = base.withColumns({"_nq": F.size("_q"), "_nb": F.size("_b")})
    arrays = _pair_arrays(context_length(text_length, num_patches), num_patches, image_token_id, pad_id, padding_side,
                          ignore_index, add_bos, bos_id)
    return base.withColumns(arrays[0]).select(*keys, *[c.alias(f) for f, c in arrays[1].items()])


def _pair_arrays(L: int, num_patches: int, image_token_id: int, pad_id: int, padding_side: str, ignore_index: int,
                 add_bos: bool, bos_id: int):
    """The training arrays of a row with ``_q`` and ``_b`` (first ids of question and answer, as many as can be
    kept) and ``_nq``, ``_nb`` (their whole lengths): (columns to add first, one column per field)."""
    sa = 1 if add_bos else 0  # special tokens before each sequence
    _check(padding_side, L, sa)
    ka, kb = _pair_lengths(F.col("_nq") + num_patches, F.col("_nb"), L - 2 * sa)
    n_a, n_b = F.col("_ka") + sa, F.col("_kb") + sa
    n_pad = F.lit(L) - n_a - n_b
    bos = F.array_repeat(F.lit(bos_id), sa)

    def padded(value: int, *parts):
        pad = F.array_repeat(F.lit(value), n_pad)
        return F.concat(*parts, pad) if padding_side == "right" else F.concat(pad, *parts)

    image = F.array_repeat(F.lit(image_token_id), F.least(F.lit(num_patches), F.col("_ka")))
    seq_a = F.concat(image, F.slice("_q", F.lit(1), F.greatest(F.col("_ka") - num_patches, F.lit(0))))
    seq_b = F.concat(bos, F.slice("_b", F.lit(1), F.col("_kb")))
    return {"_ka": ka.cast("int"), "_kb": kb.cast("int")}, {
        "input_id": padded(pad_id, bos, seq_a, seq_b),
        "token_type": padded(0, F.array_repeat(F.lit(0), n_a), F.array_repeat(F.lit(1), n_b)),
        "attention_mask": padded(0, F.array_repeat(F.lit(1), n_a + n_b)),
        "label": padded(ignore_index, F.array_repeat(F.lit(ignore_index), n_a), seq_b)}


def positions(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """The long form of encoded examples: one row per (keys, pos), no shuffle."""
    fields = [f for f in FIELDS if f in encoded.columns]
    one = F.posexplode(F.arrays_zip(*fields)).alias("pos", "_p")
    return encoded.select(*keys, one).select(*keys, "pos", *[F.col(f"_p.{f}").alias(f) for f in fields])


def encode_pair_ids_long(df: DataFrame, keys: list[str], question_ids: str, answer_ids: str, **options) -> DataFrame:
    """``encode_pair_ids`` (same options) in long form."""
    return positions(encode_pair_ids(df, keys, question_ids, answer_ids, **options), keys)


def encode_routed(df: DataFrame, keys: list[str], vocab: DataFrame,
                  question_col: str = "question", answer_col: str = "answer",
                  text_length: int = 64, num_patches: int = 257,
                  image_token_id: int | None = None, pad_id: int = PAD_ID,
                  eos_token: str = "<eos>", unk_id: int = UNK_ID,
                  padding_side: str = "right", ignore_index: int = IGNORE_INDEX,
                  add_bos: bool = False, bos_id: int = BOS_ID,
                  max_broadcast: int = MAX_ROWS) -> DataFrame:
    """P10 in one pass: rows with an answer get the training encoding, rows
    without one the inference encoding (T7: [<bos>], image tokens, the whole
    question; no truncation, no padding), chosen per row, so the input is read
    once. Adds ``mode`` ('train' / 'infer'); inference arrays have type 0, mask
    1 and the ignored label. A null question has no tokens.
    """
    L = context_length(text_length, num_patches)
    if image_token_id is None:
        image_token_id = token_id(vocab, IMAGE_TOKEN)
    none = F.array().cast("array<string>")
    train = F.col("_train")
    base = df.select(*keys, F.col(answer_col).isNotNull().alias("_train"),
                     F.coalesce(whitespace_tokens(question_col), none).alias("_qt"),
                     F.concat(F.coalesce(whitespace_tokens(answer_col), none), F.array(F.lit(eos_token))).alias("_at"))
    base = base.withColumns({"_nq": F.size("_qt"), "_nb": F.size("_at")})
    # of a training example at most L tokens can be kept; only those are looked up
    wanted = {"_q": F.when(train, F.slice("_qt", 1, L)).otherwise(F.col("_qt")), "_b": F.slice("_at", 1, L)}
    found = look_up(base, keys, wanted, vocab, "token", "id", F.lit(unk_id), max_broadcast)
    lengths, arrays = _pair_arrays(L, num_patches, image_token_id, pad_id, padding_side, ignore_index, add_bos, bos_id)
    before = [F.lit(bos_id)] * bool(add_bos) + [F.lit(image_token_id)] * num_patches
    asked = F.concat(F.array(*before).cast("array<int>"), F.col("_q"))
    n = F.size("_q") + len(before)
    infer = {"input_id": asked, "token_type": F.array_repeat(F.lit(0), n), "attention_mask": F.array_repeat(F.lit(1), n),
             "label": F.array_repeat(F.lit(ignore_index), n)}
    return found.withColumns(lengths).select(
        *keys, F.when(train, F.lit("train")).otherwise(F.lit("infer")).alias("mode"),
        *[F.when(train, arrays[f]).otherwise(infer[f]).alias(f) for f in FIELDS])


def encode_routed_long(df: DataFrame, keys: list[str], vocab: DataFrame, *args, **options) -> DataFrame:
    """``encode_routed`` (same options) in long form."""
    return positions(encode_routed(df, keys, vocab, *args, **options), [*keys, "mode"])


def encode_inference(df: DataFrame, keys: list[str], vocab: DataFrame,
                     question_col: str = "question", num_patches: int = 257,
                     image_token_id: int | None = None, unk_id: int = UNK_ID,
                     add_bos: bool = False, bos_id: int = BOS_ID,
                     max_broadcast: int = MAX_ROWS) -> DataFrame:
    """[<bos>] + image tokens + question tokens; no pair, no truncation, no padding."""
    asked = df.select(*keys, question_col, F.lit(None).cast("string").alias("_answer"))
    return encode_routed(asked, keys, vocab, question_col, "_answer", 2, num_patches, image_token_id, unk_id=unk_id,
                         add_bos=add_bos, bos_id=bos_id, max_broadcast=max_broadcast).select(
        *keys, "input_id", "attention_mask")


def encode_inference_long(df: DataFrame, keys: list[str], vocab: DataFrame, *args, **options) -> DataFrame:
    """``encode_inference`` (same options) in long form."""
    return positions(encode_inference(df, keys, vocab, *args, **options), keys)


def route_by_label(df: DataFrame, label_col: str = "answer") -> tuple[DataFrame, DataFrame]:
    """P10: (training rows, inference rows) split on a null label."""
    return df.filter(F.col(label_col).isNotNull()), df.filter(F.col(label_col).isNull())


def to_arrays(long_df: DataFrame, keys: list[str], fields: list[str],
              pos_col: str = "pos") -> DataFrame:
    """Regroup long form into one row per example with one array per field."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("_p"), *fields)))
    g = long_df.groupBy(*keys).agg(packed.alias("_s"))
    return g.select(*keys, *[F.transform("_s", field_of(f)).alias(f) for f in fields])


def field_of(name: str):
    """A one-argument lambda extracting struct field ``name`` (for ``transform``)."""
    return lambda x: x[name]


def image_token_count(ids, image_token_id: int):
    """Number of image placeholder positions of an encoded example's array of ids."""
    return F.size(F.filter(ids, lambda x: x == F.lit(image_token_id)))


def image_token_mismatch(encoded: DataFrame, image_token_id: int, num_patches: int,
                         id_col: str = "input_id") -> DataFrame:
    """P11 check: examples whose image placeholder count is not ``num_patches``.

    The image features replace exactly ``num_patches`` positions, so a
    truncated image prefix (longest-first truncation of a long question and
    answer) cannot be scattered; these rows are reported, not dropped.
    """
    counted = encoded.withColumn("n_image_tokens", image_token_count(F.col(id_col), image_token_id))
    return counted.filter(F.col("n_image_tokens") != num_patches).withColumn("expected", F.lit(num_patches))


def image_mask(ids, image_token_id: int):
    """P11 on the array form: boolean mask of image placeholder positions."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(a, lambda x: x == F.lit(image_token_id))


def mask_labels(ids, types, ignore_index: int = IGNORE_INDEX):
    """T5 on the array form: ids where the token type is 1, else ``ignore_index``."""
    i = F.col(ids) if isinstance(ids, str) else ids
    t = F.col(types) if isinstance(types, str) else types
    return F.zip_with(i, t, lambda a, b: F.when(b == 0, F.lit(ignore_index)).otherwise(a))
