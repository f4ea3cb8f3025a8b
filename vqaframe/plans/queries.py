"""Registered queries: every SURVEY section-2 operator run over the whole driver tables.

Each function takes (spark, sf_dir) and returns a DataFrame whose columns
match the SQL oracle of the same name in ``vqaframe.plans.oracle``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqaframe.functions import format_template, image_file_name, path_join
from vqaframe.functions.parse import python_float
from vqaframe.functions.strings import REFERENCE_PROMPT
from vqaframe.operators import batch as B
from vqaframe.operators import encode as E
from vqaframe.operators import generate as G
from vqaframe.operators import metrics as M
from vqaframe.operators import prepare as P
from vqaframe.operators.sampling import exact_sample, shuffled
from vqaframe.operators.udf import map_rows
from vqaframe.plans import tables as T
from vqaframe.session import shared_dir
from vqaframe.sources import archives as AR
from vqaframe.sources import dataset_io as IO
from vqaframe.sources import images as IM
from vqaframe.sources import metric_lines as ML
from vqaframe.sources import nested_json as NJ
from vqaframe.sources.images import missing_images as missing_images_op
from vqaframe.streaming import accuracy as X

R6 = 6  # decimals kept for floating-point outputs


# ---------------------------------------------------------------- preparation

def q_qa_join(spark: SparkSession, d: str) -> DataFrame:
    """P1 + P2 + J1."""
    j = P.join_questions_annotations(T.questions(spark, d), T.annotations(spark, d))
    return j.select("question_id", "image_id", "question", "answer")


def q_qa_pairs(spark, d):
    """J1 on conversations: a user turn and the assistant turn after it."""
    return T.qa_pairs(spark, d).select("conv_id", "turn", "question", "answer")


def q_format_prompt(spark, d):
    """P6."""
    docs = T.load(spark, d, "documents")
    return docs.select("doc_id", format_template(REFERENCE_PROMPT, "text").alias("question"))


def q_image_path(spark, d):
    """P7, also on ids wider than 12 digits."""
    docs = T.load(spark, d, "documents")
    wide = F.col("doc_id") * F.lit(10 ** 10)
    return docs.select("doc_id",
                       path_join(T.IMG_DIR, image_file_name(F.col("doc_id"), T.SPLIT)).alias("image_file"),
                       path_join(T.IMG_DIR, image_file_name(wide, T.SPLIT)).alias("image_file_wide"))


def _qa_dataset(spark, d, fraction=None):
    return P.build_qa_dataset(T.questions(spark, d), T.annotations(spark, d), T.SPLIT, T.IMG_DIR,
                              fraction=fraction, seed=T.SEED)


DATASET_COLS = ["question_id", "image_id", "question", "answer", "split", "img_path", "image_file"]


def q_qa_dataset(spark, d):
    """Flagship: P1-P7 + J1."""
    return _qa_dataset(spark, d).select(*DATASET_COLS)


def q_qa_train_split(spark, d):
    """Flagship with L1 + L2: exact seeded fraction of the joined rows, each with its place in the
    shuffle and the batch that holds it."""
    ds = _qa_dataset(spark, d, T.TRAIN_P)
    return B.assign_batches(ds, T.TRAIN_BATCH, dense_id="position").select(*DATASET_COLS, "position", "batch_id", "batch_pos")


def _built_already():
    raise AssertionError("the saved dataset is complete and must be reused")


def q_dataset_roundtrip(spark, d):
    """S2 + S3 + S4: saved partitioned by split, then reused and read back."""
    path = shared_dir(spark, "qa-dataset")
    build = lambda: q_qa_dataset(spark, d)
    IO.load_or_build(spark, path, build, load=True, partition_by=["split"])
    ds = IO.load_or_build(spark, path, _built_already, load=True, partition_by=["split"])
    return ds.select(*DATASET_COLS)


def q_exact_sample(spark, d):
    """A1 + L1 + L2 on documents."""
    return exact_sample(T.load(spark, d, "documents"), ["doc_id"], fraction=T.SAMPLE_P,
                        seed=T.SEED).select("doc_id")


def q_eval_cap(spark, d):
    """L3: at most EVAL_CAP instances, same seeded order."""
    return exact_sample(T.load(spark, d, "documents"), ["doc_id"], cap=T.EVAL_CAP,
                        seed=T.SEED).select("doc_id")


def q_image_prefix(spark, d):
    """P8 + P9 on the joined question/answer rows."""
    j = q_qa_join(spark, d)
    return j.select(F.col("question_id").alias("doc_id"),
                    P.image_prefix("question", T.NUM_PATCHES).alias("prompt_text"),
                    P.answer_with_eos("answer").alias("label_text"))


# ---------------------------------------------------------------- vocabulary / encoding

def _vocab(spark, d, extended=True):
    """The vocabulary of all texts that it is applied to."""
    texts = [T.load(spark, d, name, spread=True).select("text") for name in ("documents", "conversations")]
    v = E.build_vocab(texts[0].unionByName(texts[1]), "text")
    return E.extend_vocab(v) if extended else v


def _doc_token_ids(spark, d, vocab):
    docs = T.load(spark, d, "documents", spread=True).select("doc_id", "text").filter(F.size(T.tokens("text")) > 0)
    return E.token_ids(docs, ["doc_id"], "text", vocab).select("doc_id", "ids")


def q_token_ids(spark, d):
    """T1 + J3: every document token's id (unknown -> <unk>)."""
    ids = _doc_token_ids(spark, d, _vocab(spark, d, extended=False))
    return ids.select("doc_id", F.posexplode("ids").alias("pos", "token_id"))


def q_extend_vocab(spark, d):
    """T6."""
    return _vocab(spark, d, extended=True).select("token", "id")


def _pair_encoded(spark, d, pairs=None, keys=("conv_id", "turn")):
    pairs = T.qa_pairs(spark, d, spread=True) if pairs is None else pairs
    return E.encode_pairs(pairs, list(keys), _vocab(spark, d), text_length=T.TEXT_LENGTH, num_patches=T.NUM_PATCHES)


def q_pair_encode(spark, d):
    """T2-T4 (+P8, P9, T8): the training encoding, one row per position."""
    return E.positions(_pair_encoded(spark, d), ["conv_id", "turn"]).drop("label")


def q_mask_labels(spark, d):
    """T5: labels of the training encoding."""
    return E.positions(_pair_encoded(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "pos", "label")


def _length_tokenizer():
    import re
    sep = re.compile("[ \t\n\r]+")

    class LengthIds:
        """Stand-in user tokenizer: whitespace split, id = token length."""

        def encode_batch(self, texts):
            return [[len(w) for w in sep.split(t) if w] for t in texts]
    return LengthIds()


def q_pair_encode_user_tokenizer(spark, d):
    """T1 (user tokenizer, pandas UDF) + T2-T5 on id arrays: no vocabulary join."""
    p = T.qa_pairs(spark, d, spread=True)
    ids = p.select("conv_id", "turn", E.user_token_ids("question", _length_tokenizer).alias("q"),
                   E.user_token_ids("answer", _length_tokenizer).alias("a"))
    return E.encode_pair_ids_long(ids, ["conv_id", "turn"], "q", "a", text_length=T.TEXT_LENGTH,
                                  num_patches=T.NUM_PATCHES, image_token_id=T.IMAGE_TOKEN_ID)


def _listed(values, sep=","):
    """An array as text."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def q_image_mask_count(spark, d):
    """The mask of image placeholder positions of each encoded example, and how many are left."""
    vocab = _vocab(spark, d)
    image_id = E.token_id(vocab, E.IMAGE_TOKEN)
    enc = E.encode_pairs(T.qa_pairs(spark, d, spread=True), ["conv_id", "turn"], vocab, text_length=T.TEXT_LENGTH,
                         num_patches=T.NUM_PATCHES, image_token_id=image_id)
    mask = F.transform(E.image_mask("input_id", image_id), lambda x: x.cast("int"))
    return enc.select("conv_id", "turn", E.image_token_count("input_id", image_id).alias("n_image_tokens"),
                      _listed(mask, "").alias("image_mask"))


def q_collate_batches(spark, d):
    """U3 + A7: encoded QA pairs collated into training batches of 6, in the seeded shuffle's order."""
    pairs = shuffled(T.qa_pairs(spark, d, spread=True), ["conv_id", "turn"], seed=T.SEED)
    enc = _pair_encoded(spark, d, pairs, ("conv_id", "turn", "position"))
    b = B.collate(enc, E.FIELDS, T.TRAIN_BATCH, "position", keys=["conv_id", "turn"])
    arrays = [F.array_join(F.transform(f, lambda x: _listed(x)), "|").alias(f"{f}s") for f in E.FIELDS]
    return b.select("batch_id", F.col("n_rows").alias("n_examples"), _listed(F.col("conv_id")).alias("conv_ids"),
                    _listed(F.col("turn")).alias("turns"), *arrays)


def q_route_by_label(spark, d):
    """P10 + T7: labelled rows take the training encoding, the rest inference, chosen per row."""
    vocab = _vocab(spark, d)
    docs = T.load(spark, d, "documents", spread=True).select("doc_id", F.col("text").alias("question"))
    lab = T.load(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("answer"))
    enc = E.encode_routed(docs.join(lab, "doc_id", "left"), ["doc_id"], vocab,
                          text_length=T.TEXT_LENGTH, num_patches=T.NUM_PATCHES)
    return enc.select("doc_id", "mode", F.size("input_id").cast("long").alias("n_input_ids"),
                      *[_listed(F.col(f)).alias(f"{f}s") for f in E.FIELDS])


def q_missing_images(spark, d):
    """Document images absent from the listing (pages stand for image files)."""
    rows = T.load(spark, d, "documents").select(
        "doc_id", image_file_name(F.col("doc_id"), T.SPLIT).alias("image_file"))
    listing = T.load(spark, d, "pages").select(
        image_file_name(F.col("page_id"), T.SPLIT).alias("file_name"))
    return missing_images_op(rows, listing).select("doc_id", "image_file")


# ---------------------------------------------------------------- batches and metrics

def _batched_embeddings(spark, d):
    e = T.load(spark, d, "embeddings")
    return B.assign_batches(e, T.EVAL_BATCH, order_cols=[F.col("vec_id")], key_cols=["vec_id"])


def q_batch_assembly(spark, d):
    """W2 + A7: eval batches of 16 in vec_id order."""
    b = B.assemble_batches(_batched_embeddings(spark, d), ["vec_id", "label"])
    return b.select("batch_id", F.col("n_rows").cast("long"),
                    F.element_at("vec_id", 1).alias("first_vec_id"),
                    F.element_at("vec_id", -1).alias("last_vec_id"),
                    F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("labels"))


def _batch_acc(spark, d):
    b = _batched_embeddings(spark, d).withColumn("rank", (F.col("batch_id") % T.NUM_RANKS).cast("int"))
    return M.batch_accuracy(b, "embedding", "label", ("rank", "batch_id"))


def q_batch_accuracy(spark, d):
    """A2: argmax accuracy per (rank, batch)."""
    return _batch_acc(spark, d).select("rank", "batch_id", F.round("accuracy", R6).alias("accuracy"),
                                       "n_positions")


def q_mean_batch_accuracy(spark, d):
    """A3: unweighted mean of the batch accuracies."""
    m = M.mean_of_batches(_batch_acc(spark, d))
    return m.select(F.round("mean_accuracy", R6).alias("mean_accuracy"), "n_batches")


def q_metric_lines_mean(spark, d):
    """S8 + A3: parse every line with float() rules, skip junk, mean."""
    lines = T.metric_lines(spark, d)
    parsed = lines.select("rank", "line", python_float("line").alias("value"))
    m = ML.mean_of_lines(parsed)
    return m.select("n_values", F.round("mean_value", R6).alias("mean_value"))


def q_masked_cross_entropy(spark, d):
    """A4 + W1: next-position cross-entropy over sequences of 16, label 0 ignored."""
    b = _batched_embeddings(spark, d).withColumns({
        "label": F.when(F.col("label") == 0, F.lit(E.IGNORE_INDEX)).otherwise(F.col("label")),
        "attention_mask": F.lit(1)})
    m = M.masked_cross_entropy(b, ["batch_id"], "batch_pos", "embedding", "label", "attention_mask")
    return m.select(F.round("loss", R6).alias("loss"), "n_positions")


def q_next_token_pairs(spark, d):
    """W1 (array form) on benchmark texts."""
    bm = T.load(spark, d, "benchmark").select("item_id", T.tokens("text").alias("t"))
    return M.next_token_pairs(bm, ["item_id"], "t")


def _bleu_rows(spark, d):
    p = T.qa_pairs(spark, d, spread=True).select("conv_id", "turn", T.tokens("answer").alias("hyp"),
                                    T.tokens("question").alias("ref"))
    return M.sentence_bleu(p, ["conv_id", "turn"], "hyp", "ref", max_n=1)


def q_bleu1(spark, d):
    """Sentence BLEU-1 of each answer against its question."""
    return _bleu_rows(spark, d).select("conv_id", "turn", F.col("hyp_len").cast("long"),
                                       F.col("ref_len").cast("long"), "clip_1",
                                       F.round("bleu1", R6).alias("bleu1"))


def q_bleu4_corpus(spark, d):
    """A9 with n-grams 1-4: corpus BLEU-4 (uniform weights, one brevity penalty)."""
    p = T.qa_pairs(spark, d, spread=True).select("conv_id", "turn", T.tokens("answer").alias("hyp"),
                                                 T.tokens("question").alias("ref"))
    per = M.sentence_bleu(p, ["conv_id", "turn"], "hyp", "ref", max_n=4)
    return M.corpus_bleu(per, 4).select(F.round("corpus_bleu4", R6).alias("corpus_bleu4"))


def q_bleu1_corpus(spark, d):
    """A9 at corpus level."""
    return M.corpus_bleu(_bleu_rows(spark, d), 1).select(
        F.round("corpus_bleu1", R6).alias("corpus_bleu1"))


# ---------------------------------------------------------------- generation side

def q_assemble_prompt(spark, d):
    """A5: text pieces of each request, in order, no separator."""
    return G.assemble_prompt(T.media(spark, d), ["request_id"])


def q_last_media(spark, d):
    """The last image of each request wins."""
    return G.last_image(T.media(spark, d), ["request_id"])


def q_media_validation(spark, d):
    """Reason per invalid media object, null when valid."""
    return G.validate_media(T.media(spark, d)).select("request_id", "pos", "type", "error")


def q_expand_completions(spark, d):
    """G1: n = quality + toxic completions per labelled document."""
    lab = T.load(spark, d, "labels").select(
        "doc_id", (F.col("quality") + F.col("toxic")).alias("num_completions"))
    return G.expand_completions(lab).select("doc_id", "num_completions", F.col("i").cast("int"))


def q_strip_prompt(spark, d):
    """generation = prompt tokens + answer tokens; the prompt part is dropped."""
    p = T.qa_pairs(spark, d, spread=True).select("conv_id", "turn", T.tokens("question").alias("q"),
                                    T.tokens("answer").alias("a"))
    g = p.select("conv_id", "turn", F.concat("q", "a").alias("gen"), F.size("q").alias("input_len"))
    kept = G.strip_prompt("gen", "input_len", echo_prompt=False)
    return g.select("conv_id", "turn", F.size(kept).cast("int").alias("n_kept"),
                    F.array_join(kept, " ").alias("kept_text"))


def q_detokenize(spark, d):
    """Ids of every document decoded back through the vocabulary."""
    vocab = _vocab(spark, d, extended=False)
    ids = _doc_token_ids(spark, d, vocab)
    return E.decode_ids(ids, ["doc_id"], "ids", vocab).select("doc_id", "text")


def _cut(spark, d):
    docs = T.load(spark, d, "documents", spread=True)
    out, err = G.cut_at_eos(F.col("text"), eos_token=T.EOS_STANDIN)
    return docs.select("doc_id", out.alias("output"), err.alias("error"))


def q_cut_at_eos(spark, d):
    """Text before the first terminator; null plus a reason when absent."""
    return _cut(spark, d)


def q_token_structs(spark, d):
    """Every document's text re-tokenised into {text, logprob=0} structs (long form)."""
    docs = T.load(spark, d, "documents", spread=True)
    c = docs.select("doc_id", G.token_structs("text").alias("toks"))
    return c.select("doc_id", F.posexplode("toks").alias("pos", "tok")).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), F.col("tok.text").alias("text"),
        F.col("tok.logprob").alias("logprob"))


def _requests(spark, d):
    c = T.load(spark, d, "conversations").filter(F.col("role") == "user")
    r = c.select("conv_id", "turn", F.col("text").alias("prompt"),
                 F.lit(T.NUM_COMPLETIONS).alias("num_completions"))
    r = G.expand_completions(r)
    return r.withColumn("cache_key", G.cache_key("num_completions", "i", F.lit(T.MODEL),
                                                 G.prompt_uid("prompt")))


def _cache(spark, d):
    """Results of an earlier run: every answered user turn, answer as output."""
    p = T.qa_pairs(spark, d).select(F.col("question").alias("prompt"), F.col("answer").alias("output"),
                                    F.lit(T.NUM_COMPLETIONS).alias("num_completions"))
    p = G.expand_completions(p)
    keyed = p.select(G.cache_key("num_completions", "i", F.lit(T.MODEL), G.prompt_uid("prompt"))
                     .alias("cache_key"), "output")
    # one stored result per key; the smallest output if a prompt repeats
    return (keyed.groupBy("cache_key").agg(F.min("output").alias("output"))
            .withColumn("request_time", F.length("output") / 1000.0))


def q_cache_hits_misses(spark, d):
    """G7 + J4: cache key per completion, hit flag and stored output."""
    req = _requests(spark, d)
    cache = _cache(spark, d).withColumn("_hit", F.lit(True))
    j = req.join(cache, "cache_key", "left")
    return j.select("conv_id", "turn", F.col("i").cast("int"), "cache_key",
                    F.coalesce("_hit", F.lit(False)).alias("cached"), "output")


def q_result_assembly(spark, d):
    """A8 + G9: per request success, last completion's cache flag, first error.

    The cache holds an earlier run's answers. Misses run a stand-in generator
    that fails with a runtime error on prompts with a certain word.
    """
    req = _requests(spark, d)
    cache_dir = shared_dir(spark, "answered")
    G.store_results(_cache(spark, d).withColumn("run_id", F.lit("earlier")), cache_dir)
    comp = G.memoised_generate(req, cache_dir, _make_failing_generator)
    # the time that a stand-in takes says nothing
    comp = comp.withColumn("request_time", F.when(F.col("cached"), F.col("request_time")).otherwise(F.lit(0.0)))
    res = G.assemble_results(comp, ["conv_id", "turn"])
    return res.select("conv_id", "turn", "success", "cached", "error",
                      F.round("request_time", R6).alias("request_time"),
                      F.size("completions").cast("int").alias("n_completions"),
                      F.array_join(F.transform("completions", lambda x: x["text"]), " || ")
                      .alias("completion_text"))


def _make_generator():
    import re
    sep = re.compile("[ \t\n\r]+")

    class Backwards:
        """Stand-in model: the images' names, then the whole prompt's whitespace tokens, last one first."""

        def __call__(self, prompt: str, *images: str) -> str:
            return " ".join([*images, *[t for t in sep.split(prompt) if t][::-1]])

        def batch(self, prompts: list[str], *images: list[str]) -> list[str]:
            return [self(*asked) for asked in zip(prompts, *images, strict=True)]
    return Backwards()


def _make_failing_generator():
    backwards = _make_generator()

    def generate(prompt: str) -> str:
        out = backwards(prompt)
        if T.FAILING_WORD in out.split(" "):
            raise RuntimeError("the stand-in refuses this prompt")
        return out
    return generate


def q_memoised_generation(spark, d):
    """Distinct misses generated once per key in Python workers, written, joined back.

    Every prompt is asked about two images. A first run over all first
    completions fills a fresh cache; the second run, over all completions,
    finds those there (cached = true) and generates the rest.
    """
    name = F.concat(F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(".jpg"))
    req = (_requests(spark, d).withColumn("image_id", F.explode(F.array("conv_id", F.col("conv_id") + 1)))
           .withColumn("image", name)
           .withColumn("cache_key", G.cache_key("num_completions", "i", F.lit(T.MODEL), G.prompt_uid("prompt", "image"))))
    cache = shared_dir(spark, "gen-cache")
    G.memoised_generate(req.filter("i = 0"), cache, _make_generator, media_cols=("image",))
    out = G.memoised_generate(req, cache, _make_generator, media_cols=("image",))
    return out.select("conv_id", "turn", F.col("i").cast("int"), "image", "cache_key", "output", "cached")


def q_generation_bleu(spark, d):
    """A9 end to end: generate an answer for every answered user turn (G1, G7, G8),
    score it against the reference answer with BLEU-1, corpus and mean sentence level.
    """
    pairs = T.qa_pairs(spark, d, spread=True).select("conv_id", "turn", F.col("question").alias("prompt"),
                                        "answer", F.lit(1).alias("num_completions"))
    comp = G.expand_completions(pairs).withColumn(
        "cache_key", G.cache_key("num_completions", "i", F.lit(T.MODEL), G.prompt_uid("prompt")))
    gen = G.memoised_generate(comp, shared_dir(spark, "gen-cache"), _make_generator)
    scored = gen.select("conv_id", "turn", T.tokens("output").alias("hyp"), T.tokens("answer").alias("ref"))
    per = M.sentence_bleu(scored, ["conv_id", "turn"], "hyp", "ref", max_n=1)
    both = M.corpus_bleu(per, 1, with_mean=True)
    return both.select(F.round("corpus_bleu1", R6).alias("corpus_bleu1"),
                       F.round("mean_bleu1", R6).alias("mean_bleu1"), F.col("n_rows").alias("n_requests"))


def _prompt_formatter():
    """Per-worker state for the row map: the template, parsed once per worker."""
    return {"template": REFERENCE_PROMPT}


def _format_row(row: dict, state: dict) -> dict:
    # canonical composition, which no column function has, then Python's own str.format as the original applies it
    text = row["text"]
    composed = None if text is None else unicodedata.normalize("NFC", text)
    return {"doc_id": row["doc_id"], "question": state["template"].format(composed)}


def q_row_map_prompt(spark, d):
    """U1 + U4: texts brought to canonical composition (NFC) and formatted by Python per row (mapInArrow),
    over every document, with the state built once per worker. The JVM form of the template alone is ``format_prompt``."""
    docs = T.load(spark, d, "documents", spread=True).select("doc_id", "text")
    return map_rows(docs, _format_row, "doc_id long, question string", init=_prompt_formatter)


def q_stream_accuracy(spark, d):
    """S7 + X1: batch accuracies appended as per-rank lines, then summed by a stream."""
    acc = _batch_acc(spark, d).select("rank", F.col("accuracy").alias("value"))
    lines_dir = shared_dir(spark, "metric-lines")
    ML.append_metric_lines(acc, lines_dir)
    out = shared_dir(spark, "accuracy-state")
    X.run_incremental_accuracy(spark, lines_dir, shared_dir(spark, "accuracy-ckpt"), out)
    r = spark.read.parquet(out)
    return r.select(F.col("rank").cast("int").alias("rank"), F.col("n_values").cast("long"),
                    F.round("sum_value", R6).alias("sum_value"),
                    F.round("mean_value", R6).alias("mean_value"))


# ---------------------------------------------------------------- sources

def q_nested_json_roundtrip(spark, d):
    """S1 + P3: documents and labels as JSON objects with an array of records, read back in ranges of 1 MB."""
    folder, tables = shared_dir(spark, "nested-json"), []
    for name in ("documents", "labels"):
        table = T.load(spark, d, name)
        paths = NJ.write_nested_json(table, f"{folder}/{name}", "annotations")
        tables.append(NJ.read_nested_json(spark, paths, "annotations", table.schema, range_bytes=1 << 20))
    docs, labels = tables
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary"))
                                                      .alias("text_md5"), "quality", "toxic")


def _page_archives(spark, d):
    """Every page as an entry ``<id>/page.html`` of zip archives (pages stand for image files)."""
    pages = T.load(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("/page.html")).alias("entry"),
                                             F.col("html").cast("binary").alias("content"))
    written = AR.write_archives(pages, shared_dir(spark, "archives"), "entry", "content")
    return [r["archive"] for r in written.select("archive").collect()]  # one path per task of the scan


def q_archive_entries(spark, d):
    """The entries of all archives, dealt to tasks by bytes."""
    out = AR.expand_archives(spark, _page_archives(spark, d), partition_bytes=8 << 20)
    return out.select("entry", "length", F.md5("content").alias("content_md5"), "error")


def q_image_lookup(spark, d):
    """J2 + S5: rows find archived images by full path, and the matched images' bytes reach them."""
    archives = _page_archives(spark, d)
    folder = F.lit(archives[0].rsplit("/", 1)[0] + "/") if archives else F.lit("/")
    rows = T.load(spark, d, "documents").select(
        "doc_id", F.concat(folder, F.col("doc_id").cast("string"), F.lit("/page.html")).alias("image_file"))
    files = IM.archived_images(AR.expand_archives(spark, archives), with_content=True)
    matched = IM.attach_images(rows, files.drop("content"), on_missing="drop", name_col="path")
    return IM.attach_content(matched, files).select("doc_id", "image_bytes", F.md5("content").alias("content_md5"))


def q_archive_members(spark, d):
    """Archives that are bytes in a row, expanded by a table function in a lateral join."""
    pages = T.load(spark, d, "pages").select("page_id", T.zipped("url", "html").alias("content"))
    pages.createOrReplaceTempView("vqaframe_page_archives")
    name = AR.register_archive_members(spark)
    out = spark.sql(f"SELECT t.page_id, m.* FROM vqaframe_page_archives t, LATERAL {name}(t.content, true) m")
    return out.select("page_id", "entry", "length", F.md5("content").alias("content_md5"), "error")


def q_log_roundtrip(spark, d):
    """Ragged records (numbers, texts, nested fields, nulls) written as a log and read back field by field."""
    e = T.load(spark, d, "events")
    bad = F.col("event_type") == "error"
    records = e.select("event_id", F.when(~bad, F.col("value")).alias("loss"), F.when(bad, F.col("props")).alias("message"),
                       F.when(F.col("event_type") == "click", F.struct("user_id", F.col("event_type").alias("kind"))).alias("detail"))
    path = shared_dir(spark, "log")
    IO.write_log(records.select(F.parse_json(F.to_json(F.struct(*records.columns))).alias("record")), path)
    log = IO.read_log(spark, path)
    return log.select(IO.log_field("event_id", "bigint").alias("event_id"), IO.log_field("loss", "double").alias("loss"),
                      IO.log_field("message", "string").alias("message"), IO.log_field("detail.user_id", "bigint").alias("user_id"),
                      IO.log_field("detail.kind", "string").alias("kind"))


def q_metric_lines_consumed(spark, d):
    """S7 + S8 + S9: batch accuracies appended as lines, consumed in two calls; lines of the second arrive in between."""
    acc = _batch_acc(spark, d).select("rank", "batch_id", F.col("accuracy").alias("value"))
    folder = shared_dir(spark, "metric-lines")
    ML.append_metric_lines(acc.filter("batch_id % 2 = 0"), folder)
    claim = ML.claim_lines(spark, folder)
    ML.append_metric_lines(acc.filter("batch_id % 2 = 1"), folder)
    first = ML.read_claim(spark, folder, claim).withColumn("call", F.lit(1))
    second = ML.consume_lines(spark, folder).withColumn("call", F.lit(2))
    both = first.unionByName(second)
    return both.groupBy("call", "rank").agg(F.count("value").alias("n_values"), F.round(F.sum("value"), R6).alias("sum_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "qa_join": q_qa_join,
    "qa_pairs": q_qa_pairs,
    "format_prompt": q_format_prompt,
    "image_path": q_image_path,
    "qa_dataset": q_qa_dataset,
    "qa_train_split": q_qa_train_split,
    "dataset_roundtrip": q_dataset_roundtrip,
    "exact_sample": q_exact_sample,
    "eval_cap": q_eval_cap,
    "image_prefix": q_image_prefix,
    "token_ids": q_token_ids,
    "extend_vocab": q_extend_vocab,
    "pair_encode": q_pair_encode,
    "mask_labels": q_mask_labels,
    "pair_encode_user_tokenizer": q_pair_encode_user_tokenizer,
    "image_mask_count": q_image_mask_count,
    "route_by_label": q_route_by_label,
    "collate_batches": q_collate_batches,
    "missing_images": q_missing_images,
    "batch_assembly": q_batch_assembly,
    "batch_accuracy": q_batch_accuracy,
    "mean_batch_accuracy": q_mean_batch_accuracy,
    "metric_lines_mean": q_metric_lines_mean,
    "masked_cross_entropy": q_masked_cross_entropy,
    "next_token_pairs": q_next_token_pairs,
    "bleu1": q_bleu1,
    "bleu1_corpus": q_bleu1_corpus,
    "bleu4_corpus": q_bleu4_corpus,
    "assemble_prompt": q_assemble_prompt,
    "last_media": q_last_media,
    "media_validation": q_media_validation,
    "expand_completions": q_expand_completions,
    "strip_prompt": q_strip_prompt,
    "detokenize": q_detokenize,
    "cut_at_eos": q_cut_at_eos,
    "token_structs": q_token_structs,
    "cache_hits_misses": q_cache_hits_misses,
    "result_assembly": q_result_assembly,
    "memoised_generation": q_memoised_generation,
    "row_map_prompt": q_row_map_prompt,
    "generation_bleu": q_generation_bleu,
    "stream_accuracy": q_stream_accuracy,
    "nested_json_roundtrip": q_nested_json_roundtrip,
    "archive_entries": q_archive_entries,
    "archive_members": q_archive_members,
    "image_lookup": q_image_lookup,
    "log_roundtrip": q_log_roundtrip,
    "metric_lines_consumed": q_metric_lines_consumed,
}
