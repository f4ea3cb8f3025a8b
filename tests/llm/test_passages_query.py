import hashlib
import random
import re

import brute
import numpy as np
import pytest

from vqaframe.llm import queries, suffix_dedup


def test_the_remaining_text_is_a_column(spark, tmp_path):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefg h") for _ in range(450))
    texts = [f"one {passage} é", f"{passage} two", "plain é", None, "", "x" * 10 + "日" * 140, "y" + "日" * 140, "é" * 230 + "ê" + "é" * 10]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (size, removed, spans, kept) in enumerate(brute.passages([(t or "").encode() for t in texts], 400)):
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans) == (size, removed, spans)
        assert out[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert out[i].text.replace("�", "") == kept.decode("utf-8", "ignore")
    assert passage not in out[0].text and passage not in out[1].text and out[2].text == "plain é"


def passages_of_words(rows, length):
    """[(byte ranges, text with one of each)] of (id, text) rows in rising order; equal rows are one place."""
    places = [[x.span() for x in re.finditer(r"[^\x20\x09-\x0D]+", t)] for _, t in rows]
    count, first = {}, {}
    windows = [[tuple(t[a:b] for a, b in p[w:w + length]) for w in range(len(p) - length + 1)] for (_, t), p in zip(rows, places)]
    for (i, _), seen in zip(rows, windows):
        for w, x in enumerate(seen):
            count[x] = count.get(x, 0) + 1
            first.setdefault(x, (i, w))
    out = []
    for (i, t), p, seen in zip(rows, places, windows):
        ranges = []
        for wanted in (lambda w, x: count[x] > 1, lambda w, x: first[x] != (i, w)):
            words = {v for w, x in enumerate(seen) if wanted(w, x) for v in range(w, w + length)}
            # neighbouring words are one range where windows overlap or touch, that is always
            ranges.append([(p[v][0], next(p[u][1] for u in range(v, len(p)) if u + 1 not in words)) for v in sorted(words) if v - 1 not in words])
        kept, at = "", 0
        for a, b in ranges[1]:
            kept, at = kept + t[at:a], b
        size = lambda x: len(t[:x].encode())
        out.append(([(size(a), size(b)) for a, b in ranges[0]], kept + t[at:] if ranges[1] else None))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 400])
def test_passages_by_words(spark, monkeypatch, piece):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    pieces = [[word() for _ in range(rng.randint(8, 40))] for _ in range(10)]
    texts = []
    for _ in range(60):
        words = [w for _ in range(rng.randint(0, 9)) for w in (rng.choice(pieces) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 20))])]
        texts.append("".join(rng.choice(["", "", " "]) + w + rng.choice([" ", "\n", "\t "]) for w in words))
    texts += ["", " \n", "a " * 90, "b " * 11, " ".join("xyz"[i % 3] for i in range(60))] + texts[:3]
    rows = list(enumerate(texts))
    rows.append(rows[0])  # a row that comes twice
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [np.concatenate(x) for x in zip(*suffix_dedup.passage_anchors([t.encode() for t in texts], 12))]
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    again = [np.concatenate(x) for x in zip(*suffix_dedup.passage_anchors([t.encode() for t in texts], 12))]
    windows = [{(k, a, w, h) for k, a, s, e, h in zip(*(x.tolist() for x in f[:5])) for w in range(s, e + 1)} for f in (found, again)]
    assert windows[0] == windows[1]
    if piece > 400:
        out = suffix_dedup.cut_passages(df, length=100, gram=30, words=11).collect()
        want = passages_of_words(rows, 12)
        assert sum(o is not None for _, o in want) > 30 and any(r and o is None for r, o in want)
        assert sorted((r.id, [tuple(x) for x in r.passages], r.once or "") for r in out) == [
            (i, x, o or "") for (i, _), (x, o) in zip(rows, want)]
        plain = suffix_dedup.cut_passages(df, length=100, gram=30).collect()
        assert sorted((r.id, bytes(r.kept)) for r in out) == sorted((r.id, bytes(r.kept)) for r in plain)


def test_short_passages_of_many_words_are_found(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage, fifty = own(51), own(50)  # both under 400 bytes
    texts = [f"{own(30)} {passage} {own(30)}", f"{own(9)}\n{passage.replace(' ', chr(10), 5)}\n{own(9)}", f"x{fifty} {own(5)}", f"{own(5)} x{fifty}", own(200), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < 400 and all(out[i].n_removed == 0 for i in out)
    assert [(out[i].n_passages, out[i].n_passage_bytes) for i in range(7)] == [(1, len(passage))] * 2 + [(0, 0)] * 5
    assert [out[i].text_once for i in range(7)] == [texts[0], texts[1].replace(passage.replace(" ", "\n", 5), "")] + [t or "" for t in texts[2:]]
