import random

import pytest

from vqaframe.operators import encode as E


def ref_truncate(la, lb, L):
    """Longest-first lengths, written from the closed-form description."""
    if la + lb <= L:
        return la, lb
    swap = la > lb
    n1, n2 = (lb, la) if swap else (la, lb)
    n2 = n1 if n1 > L else max(n1, L - n1)
    if n1 + n2 > L:
        n1, n2 = L // 2, L // 2 + L % 2
    return (n2, n1) if swap else (n1, n2)


@pytest.fixture(scope="module")
def vocab(spark):
    corpus = spark.createDataFrame([("the cat the dog",), ("a cat",), ("<eos> x",)], "text string")
    return E.extend_vocab(E.build_vocab(corpus, "text"))


def test_vocab_ids_and_extension(spark, vocab):
    v = dict((r["token"], r["id"]) for r in vocab.collect())
    assert [v[t] for t in E.SPECIAL_TOKENS] == [0, 1, 2, 3]
    # the: 2, cat: 2 -> (count desc, token): cat, the, then a, dog, x
    assert [v["cat"], v["the"], v["a"], v["dog"], v["x"]] == [4, 5, 6, 7, 8]
    assert v["<image>"] == 9
    again = E.extend_vocab(vocab)
    assert again.count() == vocab.count()  # no-op when present


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "k int, question string, answer string")


def _arrays(spark, vocab, rows, L_text, npch, side="right"):
    long = E.encode_pairs_long(_pairs(spark, rows), ["k"], vocab, text_length=L_text,
                               num_patches=npch, padding_side=side)
    return {r["k"]: r for r in E.to_arrays(long, ["k"], ["input_id", "token_type", "attention_mask",
                                                         "label"]).collect()}


def test_pair_encoding_edges(spark, vocab):
    rows = [(1, "the cat", "dog"),              # fits
            (2, "the cat the dog a", "cat"),    # question longer -> truncated
            (3, "", ""),                        # empty question, empty answer (only <eos>)
            (4, "a " * 20, "the " * 20)]        # both long
    out = _arrays(spark, vocab, rows, L_text=6, npch=2)
    L = 8
    img = 9
    for r in out.values():
        assert len(r["input_id"]) == L and len(r["attention_mask"]) == L
        assert all((lab == -100) == (t == 0) for lab, t in zip(r["label"], r["token_type"]))
    assert out[1]["input_id"] == [img, img, 5, 4, 7, 1, 0, 0]
    assert out[1]["token_type"] == [0, 0, 0, 0, 1, 1, 0, 0]
    assert out[1]["attention_mask"] == [1, 1, 1, 1, 1, 1, 0, 0]
    assert out[1]["label"] == [-100, -100, -100, -100, 7, 1, -100, -100]
    assert out[2]["input_id"] == [img, img, 5, 4, 5, 7, 4, 1]
    assert out[3]["input_id"] == [img, img, 1, 0, 0, 0, 0, 0]
    assert out[4]["input_id"] == [img, img, 6, 6, 5, 5, 5, 5]


def test_left_padding(spark, vocab):
    out = _arrays(spark, vocab, [(1, "cat", "dog")], L_text=4, npch=1, side="left")
    assert out[1]["input_id"] == [0, 9, 4, 7, 1]
    assert out[1]["attention_mask"] == [0, 1, 1, 1, 1]


def test_truncation_property(spark, vocab):
    rnd = random.Random(7)
    rows = [(i, " ".join(["cat"] * rnd.randint(0, 30)), " ".join(["dog"] * rnd.randint(0, 30)))
            for i in range(60)]
    L_text, npch = 11, 3
    L = L_text + npch
    out = _arrays(spark, vocab, rows, L_text, npch)
    for k, q, a in rows:
        la, lb = npch + len(q.split()), len(a.split()) + 1
        ka, kb = ref_truncate(la, lb, L)
        r = out[k]
        assert len(r["input_id"]) == L
        assert sum(r["attention_mask"]) == ka + kb
        assert sum(r["token_type"]) == kb
        assert r["input_id"].count(9) == min(npch, ka)


def test_inference_and_routing(spark, vocab):
    df = _pairs(spark, [(1, "the cat zebra", "dog"), (2, "a", None)])
    train, infer = E.route_by_label(df)
    assert [r["k"] for r in train.collect()] == [1]
    inf = E.encode_inference_long(infer, ["k"], vocab, num_patches=3)
    arr = E.to_arrays(inf, ["k"], ["input_id", "attention_mask"]).first()
    assert arr["input_id"] == [9, 9, 9, 6] and arr["attention_mask"] == [1, 1, 1, 1]
    unk = E.encode_inference_long(df.filter("k = 1"), ["k"], vocab, num_patches=0)
    assert E.to_arrays(unk, ["k"], ["input_id"]).first()["input_id"] == [5, 4, 3]


def test_image_count_and_mask(spark, vocab):
    arr = E.encode_pairs(_pairs(spark, [(1, "cat", "dog")]), ["k"], vocab, text_length=4, num_patches=3)
    assert arr.select(E.image_token_count("input_id", 9).alias("n")).first()["n"] == 3
    m = arr.select(E.image_mask("input_id", 9).alias("m"),
                   E.mask_labels("input_id", "token_type").alias("lab")).first()
    assert m["m"][:4] == [True, True, True, False]
    assert m["lab"][:6] == [-100, -100, -100, -100, 7, 1]


@pytest.mark.parametrize("sent", [True, False])
def test_ids_and_decoding_roundtrip(spark, vocab, sent):
    """Looked up inside the row, with the vocabulary sent along or (too large) joined with each row's own tokens."""
    rows = [(1, "the cat  sat\tthe"), (2, "x"), (3, None), (4, ""), (None, "dog " * 500 + "cat")]
    df = spark.createDataFrame(rows, "k int, text string")
    bound = {} if sent else {"max_broadcast": 0}
    ids = E.token_ids(df, ["k"], "text", vocab, **bound)
    got = {r["k"]: r["ids"] for r in ids.collect()}
    assert got == {1: [5, 4, 3, 5], 2: [8], 3: None, 4: [], None: [7] * 500 + [4]}
    text = {r["k"]: r["t"] for r in E.decode_ids(ids, ["k"], "ids", vocab, "t", **bound).collect()}
    assert text == {1: "the cat <unk> the", 2: "x", 3: None, 4: "", None: "dog " * 500 + "cat"}
    plan = E.token_ids(df, ["k"], "text", vocab, **bound)._jdf.queryExecution().executedPlan().toString()
    if sent:  # nothing is exploded, joined or moved but the vocabulary itself
        assert "Generate" not in plan.split("Subquery")[0] and "Join" not in plan.split("Subquery")[0]
    assert E.token_ids(df.limit(0), ["k"], "text", vocab, **bound).count() == 0


def test_vocabulary_has_a_largest_size(spark):
    corpus = spark.createDataFrame([("b a c a b a d",)], "text string")
    v = E.build_vocab(corpus, "text", max_size=6)
    assert [r["token"] for r in v.orderBy("id").collect()] == [*E.SPECIAL_TOKENS, "a", "b"]
    empty = E.build_vocab(corpus.limit(0), "text")
    df = spark.createDataFrame([(1, "a b")], "k int, text string")
    assert E.token_ids(df, ["k"], "text", empty).first()["ids"] == [3, 3]


def test_context_length():
    assert E.context_length(64, 257) == 321
    with pytest.raises(ValueError):
        E.context_length(-1, 3)


def test_bos_template_and_exact_fit(spark, vocab):
    rows = [(1, "the cat", "dog"), (2, "a " * 20, "the " * 20)]
    long = E.encode_pairs_long(_pairs(spark, rows), ["k"], vocab, text_length=6, num_patches=2,
                               add_bos=True)
    out = {r["k"]: r for r in E.to_arrays(long, ["k"], ["input_id", "token_type", "label"]).collect()}
    # <bos> img img the cat | <bos> dog <eos>  (L = 8: exactly full, no padding)
    assert out[1]["input_id"] == [2, 9, 9, 5, 4, 2, 7, 1]
    assert out[1]["token_type"] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert out[1]["label"] == [-100, -100, -100, -100, -100, 2, 7, 1]
    # both long: budget L - 2 = 6 split 3 / 3
    assert out[2]["input_id"] == [2, 9, 9, 6, 2, 5, 5, 5]
    inf = E.encode_inference_long(_pairs(spark, [(3, "cat", None)]), ["k"], vocab, num_patches=2,
                                  add_bos=True)
    assert E.to_arrays(inf, ["k"], ["input_id"]).first()["input_id"] == [2, 9, 9, 4]
    exact = _arrays(spark, vocab, [(4, "the cat", "a")], L_text=4, npch=1)  # 1 + 2 + 2 = L
    assert exact[4]["input_id"] == [9, 5, 4, 6, 1] and exact[4]["attention_mask"] == [1] * 5


def test_broadcast_only_within_measured_bounds(spark, vocab):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    toks = E.tokens_long(spark.createDataFrame([(1, "the cat")], "k int, text string"), ["k"], "text")
    small = E.lookup_ids(toks, vocab)
    assert "BroadcastHashJoin" in plan(small)
    big = E.lookup_ids(toks, vocab, max_broadcast=3)  # over the row bound: no broadcast hint
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(big)
        v = E.sized_broadcast(vocab.withColumnRenamed("token", "_tok"), max_bytes=10)  # over bytes
        assert "BroadcastHashJoin" not in plan(toks.join(v, toks["token"] == v["_tok"], "left"))
        v = E.sized_broadcast(vocab.withColumnRenamed("token", "_tok"))
        assert "BroadcastHashJoin" in plan(toks.join(v, toks["token"] == v["_tok"], "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_join_path_matches_broadcast(spark, vocab):
    rows = [(1, "the cat zebra", "dog a"), (2, "a " * 9, "the"), (3, "", "")]
    fields = ["input_id", "token_type", "attention_mask", "label"]

    def enc(mb):
        long = E.encode_pairs_long(_pairs(spark, rows), ["k"], vocab, text_length=6, num_patches=2,
                                   max_broadcast=mb)
        return sorted(tuple(r) for r in E.to_arrays(long, ["k"], fields).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert enc(0) == enc(E.MAX_ROWS)
        inf = E.encode_inference_long(_pairs(spark, rows), ["k"], vocab, num_patches=2, max_broadcast=0)
        got = {r["k"]: r["input_id"] for r in E.to_arrays(inf, ["k"], ["input_id"]).collect()}
        assert got[1] == [9, 9, 5, 4, 3] and got[3] == [9, 9]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_routed_encoding_equals_separate_encoders(spark, vocab):
    rows = [(1, "the cat zebra", "dog a"), (2, "a " * 9, None), (3, "", ""), (4, "cat", None)]
    df = _pairs(spark, rows)
    routed = E.encode_routed_long(df, ["k"], vocab, text_length=6, num_patches=2, add_bos=True)
    train, infer = E.route_by_label(df)
    tr = E.encode_pairs_long(train, ["k"], vocab, text_length=6, num_patches=2, add_bos=True)
    inf = E.encode_inference_long(infer, ["k"], vocab, num_patches=2, add_bos=True)
    got_tr = sorted(tuple(r) for r in routed.filter("mode = 'train'").drop("mode").collect())
    assert got_tr == sorted(tuple(r) for r in tr.collect())
    got_inf = sorted(tuple(r) for r in routed.filter("mode = 'infer'")
                     .select("k", "pos", "input_id", "attention_mask").collect())
    assert got_inf == sorted(tuple(r) for r in inf.collect())
    modes = {r["k"]: r["mode"] for r in routed.select("k", "mode").distinct().collect()}
    assert modes == {1: "train", 2: "infer", 3: "train", 4: "infer"}


def test_image_token_mismatch_reports_truncated_prefix(spark, vocab):
    rows = [(1, "cat", "dog"), (2, "a " * 20, "the " * 20)]
    enc = E.encode_pairs(_pairs(spark, rows), ["k"], vocab, text_length=2, num_patches=4)
    bad = {r["k"]: r["n_image_tokens"] for r in E.image_token_mismatch(enc, 9, 4).collect()}
    assert bad == {2: 3}


def test_user_tokenizer_and_id_encoder(spark):
    def make():
        table = {"what": 11, "is": 12, "it": 13, "cat": 14}

        class Tok:
            def encode_batch(self, texts):
                return [[table.get(w, 3) for w in t.lower().split()] for t in texts]
        return Tok()

    df = spark.createDataFrame([(1, "What is it", "cat"), (2, None, "cat"), (3, "it", None)],
                               "k int, question string, answer string")
    ids = df.select("k", E.user_token_ids("question", make).alias("q"), E.user_token_ids("answer", make).alias("a"))
    got = {r["k"]: (r["q"], r["a"]) for r in ids.collect()}
    assert got[1] == ([11, 12, 13], [14]) and got[2] == (None, [14]) and got[3] == ([13], None)
    long = E.encode_pair_ids_long(ids, ["k"], "q", "a", text_length=5, num_patches=2, image_token_id=99)
    arr = {r["k"]: r for r in E.to_arrays(long, ["k"], ["input_id", "token_type", "label"]).collect()}
    assert arr[1]["input_id"] == [99, 99, 11, 12, 13, 14, 1]
    assert arr[1]["label"] == [-100] * 5 + [14, 1]
    assert arr[3]["input_id"] == [99, 99, 13, 1, 0, 0, 0]
