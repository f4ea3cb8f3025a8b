import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vqaframe.llm import (license_scan, line_dedup, packing, quality, sentencepiece_fst, simhash, suffix_dedup,
                          token_count)

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_token_counts_equal_the_library(edge, empty):
    tok = Tokenizer.from_file(WORD)
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows_of(edge))
    out = token_count.count_tokens(edge, WORD).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out) and any(r.over_limit for r in out)
    assert token_count.count_tokens(empty, WORD).count() == 0


def test_whole_tokens_are_proved():
    tok = Tokenizer.from_file(WORD)
    whole = token_count.prove_whole_tokens(tok)
    rng = random.Random(1)
    for p in rng.sample(whole, 300):
        assert [t.value for t in tok.model.tokenize(token_count.to_symbols(p))] == [token_count.to_symbols(p) + "</w>"]


def check_packing(rows, docs, most=1024):
    tok = Tokenizer.from_file(BYTE)
    want = sorted((str(i), zlib.crc32(ids[a:a + n].tobytes()), a, n, k) for i, t in docs
                  for ids in [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")]
                  for k, (a, n) in enumerate(packing.cut_pieces(len(ids), most)))
    assert sorted((str(r[0]), r.ids_crc32, r.start, r.length, r.piece) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= most
    return len(seqs)


def test_packing(edge, empty):
    rows = packing.pack_documents(edge, BYTE).collect()
    n = check_packing(rows, rows_of(edge))
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(empty, BYTE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 500, 800)
    caps = (1000, 4, 400_000)
    seq, offset = packing.best_fit(lengths, caps, (1.0, 0.2, 0.5), rule)
    for s in np.unique(seq):
        x = lengths[seq == s]
        assert x.sum() <= caps[0] and len(x) <= caps[1] and (x ** 2).sum() <= caps[2]
        order = np.argsort(offset[seq == s])
        assert (offset[seq == s][order] == np.r_[0, np.cumsum(x[order])[:-1]]).all()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), caps)


def test_sentencepiece_equals_the_library(edge, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(edge, PIECE), PIECE).collect()
    want = sorted((str(i), sp.encode(t or "")) for i, t in rows_of(edge))
    assert sorted((str(r.id), list(r.ids)) for r in out) == want
    assert all(r.decoded == sp.decode(list(r.ids)) for r in out)
    assert all(r.decoded == r.text.replace("▁", " ") for r in out)
    both = sentencepiece_fst.encode(edge, PIECE, decoded_col="decoded").collect()
    assert sorted((str(r.id), list(r.ids), r.decoded) for r in both) == sorted((str(r.id), list(r.ids), r.decoded) for r in out)
    assert sentencepiece_fst.encode(empty, PIECE).count() == 0


def test_sentencepiece_random_strings():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.compile_model(PIECE))
    rng = random.Random(5)
    letters = "aeinrstlodhé  \n\t▁.,0129🙂ß你²½_'\u0301नमि"
    for _ in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(fst.encode(t), "<i4").tolist()
        assert ids == sp.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")
    for t in ("▁" * 5000, "the" * 3000, "\n" * 999 + "a", "²." * 50, "ing" * 700 + "!" * 700):
        assert np.frombuffer(fst.encode(t), "<i4").tolist() == sp.encode(t)


def test_line_dedup(edge, empty):
    out = line_dedup.dedup_lines(edge).select("id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, brute.line_dedup(rows_of(edge))))
    assert any(r.n_dropped for r in out)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_long_and_shared(spark):
    rng = random.Random(2)
    lines = [f"common line number {i} of this corpus" for i in range(30)]
    docs = [(i, "\n".join(rng.choice(lines + ["short", f"own line of document {i} here"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, out.collect())) == sorted(brute.line_dedup(docs))


def test_quality_base_columns(edge, empty):
    rated = quality.rate_documents(edge).collect()
    got = sorted(str((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rated)
    assert got == sorted(str((i, *brute.base_stats(t))) for i, t in rows_of(edge))
    assert not any(r.kept and r.base_failed for r in rated)
    assert quality.rate_documents(empty).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    plain = " ".join(f"w{i:04d}" for i in range(80))
    noisy = " ".join(f"w{i:04d}&" for i in range(80))
    junk = " ".join(f"w{i:04d}&&&$$$" for i in range(80))
    docs = [(i, f"{plain} a{i}", "en", "books") for i in range(150)] + [(1000, junk, "en", "books"), (1001, noisy, "en", "books")]
    docs += [(2000 + i, f"{noisy} a{i}", "en", "code") for i in range(150)] + [(3000, junk, "en", "code")]
    kept = {r.id for r in quality.rate_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
            .filter("kept").collect()}
    assert kept == {i for i, *_ in docs} - {1000, 1001, 3000}  # a symbol a word is junk among books, usual among code


def test_sketch_buckets(spark):
    v = F.col("id")
    out = spark.range(0, 5000).select("id", quality.bucket(v).alias("b"), quality.bucket_top(quality.bucket(v)).alias("top")).collect()
    tops = {}
    for r in out:
        assert r.id <= r.top <= r.id * 33 // 32 + 1
        tops.setdefault(r.b, r.top)
        assert tops[r.b] == r.top
    assert sorted(tops) == list(range(len(tops)))


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(edge, empty, block):
    out = simhash.near_duplicates(edge, block=block).collect()
    docs = rows_of(edge)
    prints = [brute.simhash(t) for _, t in docs]
    group = brute.components(prints)
    least = {g: min((i for (i, _), x in zip(docs, group) if x == g and i is not None), default=None) for g in set(group)}
    assert sorted(str((r.id, r.fp % 2 ** 64, r.component_id)) for r in out) == sorted(
        str((i, p, least[g])) for (i, _), p, g in zip(docs, prints, group))
    if block == 2:
        kept = simhash.keep_one(edge)
        assert kept.columns == edge.columns and kept.count() == len(set(group))
        assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 40])
def test_simhash_links_connect_all_pairs(spark, block):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c for c in centres}
    for c in centres:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block=block)).collect()
    root = {r.node: r.root for r in got}
    want = brute.components(prints)
    named = [root.get(s, s) for s in signed]
    assert len(set(zip(named, want))) == len(set(named)) == len(set(want))


def test_segments_leave_one_with_at_most_one_bit():
    for bits in range(1, 12):
        parts = simhash.segments(bits)
        assert sum(w for _, w in parts) == 64 and bits // len(parts) <= 1 and [a for a, _ in parts] == sorted(a for a, _ in parts)


@pytest.mark.parametrize("most", [1024, 2])
def test_repeated_passages(spark, edge, empty, most):
    rng = random.Random(11)
    pieces = ["".join(rng.choice("ab c") for _ in range(rng.randint(60, 300))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 90)))
                     for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["a" * 500, None, "", "x" * 99, "y" * 100, "z" * 101]
    docs = list(enumerate(texts))
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = suffix_dedup.cut_passages(df, length=100, gram=30, most=most).collect()
    want = brute.passages([(t or "").encode() for _, t in docs], 100)
    assert sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == sorted(
        (i, *w) for (i, _), w in zip(docs, want))
    if most == 2:
        docs = rows_of(edge)
        out = suffix_dedup.cut_passages(edge).collect()
        want = brute.passages([(t or "").encode() for _, t in docs], 400)
        assert sorted(str((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in out) == sorted(
            str((i, *w)) for (i, _), w in zip(docs, want))
        assert suffix_dedup.cut_passages(empty).count() == 0


@pytest.mark.parametrize("most", [1024, 2])
def test_one_copy_of_a_passage_stays(spark, most):
    rng = random.Random(12)
    pieces = ["".join(rng.choice("ab c") for _ in range(rng.randint(60, 300))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 90)))
                     for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += ["a" * 500, "", "x" * 99] + texts[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = suffix_dedup.cut_passages(df, length=100, gram=30, most=most, keep_first=True).collect()
    want = brute.passages_kept_once([t.encode() for t in texts], 100)
    assert sorted((r.id, r.n_removed, bytes(r.kept)) for r in out) == [(i, *w) for i, w in enumerate(want)]
    twice = suffix_dedup.cut_passages(df.filter("doc_id = 60").union(df.filter("doc_id = 60")), length=400, keep_first=True)
    assert {bytes(r.kept) for r in twice.collect()} == {b"a" * 400}  # rows of equal id and text are one place


def test_long_texts_are_cut_like_short_ones(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.text_anchors([text], 30, 100))]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.text_anchors([text], 30, 100))]
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_license_scan(spark, empty):
    docs = [(1, "intro.\nReleased under the MIT License.\nend"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."),
            (5, "This work is licensed under the GNU General Public License, version 2."),
            (6, "all rights reserved by nobody, and all the rights in question were never granted by anyone at all"),
            (7, "no such thing here")] + [(8, "Licensed under CC BY-NC 4.0.")] * 2
    out = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r.id, r.license, r.n_diff, r.confirmed) for r in out)
    assert got == [(1, "MIT", 0, True), (4, "Apache-2.0", 0, True), (5, "GPL-2.0", 0, True), (6, "ARR", 0, True),
                   (8, "CC-BY-NC-4.0", 0, True), (8, "CC-BY-NC-4.0", 0, True)]
    assert all(r.size_given < r.size_alone for r in out)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_blocks_across_lines_and_marks(spark):
    bsd = ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided "
           "that the following conditions\n# are met.\n")
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and t.startswith("Permission")).split()
    mit = "/*\n" + "".join(f" * {' '.join(mit[i:i + 9])}\n" for i in range(0, len(mit), 9)) + " */"
    docs = [(1, "x = 1\n" + bsd + "y = 2"), (2, mit + "\nint x;\n" + bsd), (3, "Licensed under the\nApache License,\nVersion 2.0."),
            (4, "licensed under no terms at all")]
    out = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.id, r.license, r.n_diff) for r in out if r.confirmed) == [
        (1, "BSD-3-Clause", 0), (2, "BSD-3-Clause", 0), (2, "MIT", 0), (3, "Apache-2.0", 0)]
    assert {r.id for r in out if not r.confirmed} == {4}


LGPL = next(t for n, t in license_scan.TEMPLATES if n == "LGPL-3.0-or-later" and t.startswith("This program"))


@pytest.mark.parametrize(("text", "license"), [
    (LGPL, "LGPL-3.0-or-later"), (LGPL.replace("Lesser ", ""), "GPL-3.0-or-later"), (LGPL.replace("Lesser", "Affero"), "AGPL-3.0-or-later"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 3.0.", None), ("Licensed under CC BY 2.0.", None),
    ("This work is licensed under the GNU General Public License, version 1.", None)])
def test_names_versions_and_clauses_are_exact(text, license):
    found = license_scan.Scanner(license_scan.TEMPLATES).blocks(f"before it {text} and after")
    assert [x[2] for x in found if x[6]] == ([license] if license else [])
    assert found


def test_every_template_is_found_as_itself():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES:
        assert [(x[2], x[5]) for x in scanner.blocks(f"x y {text} z") if x[6]] == [(name, 0)], (name, text[:40])


def test_sizes_decide(monkeypatch):
    """Ranked by brute force over all templates; without the sizes the ranking falls back to the list's order."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    texts = [t.lower().replace("software", "program code") for _, t in license_scan.TEMPLATES if len(t.split()) > 30]
    texts.append("this work is licensed under a creative commons attribution-noncommercial-sharealike 2.5 license")
    rows = [x for t in texts for x in scanner.blocks(t)]
    for _, block, name, alone, given, _, _ in rows:
        sizes = [len(c.compress(block.encode())) for c in scanner.given]
        assert given == min(sizes) and name in [n for (n, _), size in zip(scanner.templates, sizes) if size == given]

    class Zero:
        def compress(self, _):
            return b""

    monkeypatch.setattr(scanner, "given", [Zero()] * len(scanner.given))
    assert [x[:3] for x in rows] != [x[:3] for t in texts for x in scanner.blocks(t)]


def test_license_scan_misses_no_block_within_the_limit():
    rng = random.Random(7)
    want = [f"w{i % 17}" for i in range(23)]
    scanner = license_scan.Scanner([("T", " ".join(want))])

    def fewest(have):  # all alignments; words before and after the block are free
        row = [0] * (len(have) + 1)
        for i, w in enumerate(want):
            prev, row = row, [i + 1]
            for j, h in enumerate(have):
                row.append(min(prev[j + 1] + 1, row[j] + (i + 1 < len(want)), prev[j] if h == w else 99))
        return min(row)

    for _ in range(400):
        have = list(want)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(have))
            have[at:at + rng.randrange(2)] = [rng.choice(want)] * rng.randrange(2)
        have = ["x"] * rng.randrange(4) + have + ["y"] * rng.randrange(4)
        found = [x[5] for x in scanner.blocks(rng.choice([" ", "\n", "\n# "]).join(have)) if x[6]]
        best = fewest(have)
        assert (min(found) == best) if best <= 4 else not found
