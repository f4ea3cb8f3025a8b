import hashlib
import random
import re
import zlib
from itertools import count

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaframe.llm import fill_middle, periodic, queries, secret_scan

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, id string, n int, spans string, version string, runs string"


def fill_middle_row(i, t):
    t = t or ""
    u = UNIT.findall(t)
    s = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(s[8 * k:8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_unit_borders(monkeypatch):
    rng = random.Random(1)
    for block in (1 << 17, 2):
        monkeypatch.setattr(fill_middle, "_BLOCK", block)
        for _ in range(1000):
            t = "".join(rng.choice("abzAZ@[`{ \n1é漢🙂\x7f\x80\x00") for _ in range(rng.randint(0, 60)))
            units, want = fill_middle.Units(t.encode()), UNIT.findall(t)
            assert units.n == len(want)
            assert [units.border(k) for k in range(len(want) + 1)] == [len("".join(want[:k]).encode()) for k in range(len(want) + 1)]


def test_fill_in_middle(spark, edge, empty):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z", "w") for i, t in enumerate(
        ["", None, "a", "<P>", "x<S", "<", "one two\n", "é🙂" * 500, "word " * 30000] + [f"sun {k}, é{k} moon" for k in range(150)])], SCHEMA)
    for df in (docs, docs.unionByName(docs), edge):
        out = fill_middle.fill_in_middle(df)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(fill_middle_row(i, t)) for i, t in rows)
        again = out.select("id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert sorted(map(str, map(tuple, again))) == sorted(str((i, t or "")) for i, t in rows)
    assert {r.form for r in fill_middle.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty).count() == 0


def base_spans(t):
    out = []
    for k, (kind, pattern, least) in enumerate((
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        for m in re.finditer(pattern, t or ""):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


SECRET_TEXTS = [
    None, "", "token", "token=token :abcdefg", "token = \"abcdef\" 🙂 Password:'abcde' api_key=abc.def-1", "a" * 30 + " " + "f" * 24,
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "Z9" * 30, "SECRET==x= passwd  :  aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "secret=" + "9f" * 300_000, "deadbeef " * 3000, "ſecret=abcdefgh toKen=abcdefgh", "key " + "Zq8_vX2+Lp9/Wt4-Rk7=Jm3" + " end",
    "api" + "_" * 40 + "key token:\"" + "x" * 6, "ordinarywordsfollowone another internationalization_of_things", "1234567890123456 98765432109876543210"]


def test_secret_spans(spark, edge, empty):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z", "w") for i, t in enumerate(SECRET_TEXTS * 2)] +
                                 [(3, SECRET_TEXTS[3], "x", 1, "y", "z", "w"), (None, SECRET_TEXTS[4], None, None, None, None, None)], SCHEMA)
    for df in (docs.repartition(3), edge):
        out = secret_scan.scan_secrets(df).collect()
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted(str((r.id, [(s.start, s.kind_no, s.end, s.kind) for s in r.spans if s.kind_no < 3])) for r in out)
        assert got == sorted(str((i, base_spans(t))) for i, t in rows)
        for r in out:
            assert r.spans == sorted(r.spans, key=lambda s: (s.start, s.kind_no))
            added = [s for s in r.spans if s.kind == "markov"]
            assert all(s.llr >= 10_000 and s.end - s.start >= 16 for s in added)
            assert not any(a.start < b.end and b.start < a.end for a in added for b in r.spans if b.kind_no < 3)
    assert secret_scan.scan_secrets(empty).count() == 0


def test_models_tell_held_out_strings(spark):
    """Trained on the corpus's own labels; tried on strings that it never saw."""
    rng = random.Random(9)
    con = duckdb.connect()
    words = sorted({w for (t,) in con.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
                    for w in re.findall(r"[a-z]{3,}", t or "")})
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", secret_scan.ALPHABET[:64]]
    secrets = ["k" + "".join(rng.choice(a) for _ in range(rng.randint(22, 40))) for _ in range(100) for a in alphabets]
    names = ["_".join(rng.choice(words) for _ in range(rng.randint(3, 6))) for _ in range(300)]
    names = [n for n in names if len(n) >= 16]
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = secret_scan.find_matches(known.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text"), 16)
    scores = secret_scan.transition_scores(secret_scan.labelled_samples(known, train, "doc_id", "text", 500), 1.0)
    df = spark.createDataFrame([(x, True) for x in secrets] + [(x, False) for x in names], "value string, random boolean")
    rows = df.withColumn("llr", secret_scan.likelihood_ratio(F.col("value"), scores)).collect()
    found = [r.llr >= 10_000 for r in rows if r.random]
    wrong = [r.llr >= 10_000 for r in rows if not r.random]
    assert sum(found) >= 0.95 * len(found) and sum(wrong) <= 0.01 * len(wrong)
    own = secret_scan.transition_scores(df.filter("random").union(df.filter("not random")), 1.0)  # labelled by the caller
    assert len(own.split(",")) == len(secret_scan.ALPHABET) ** 2
    text = f"see {secrets[2]} and {names[0]}"
    out = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), samples=df).first()
    assert [(s.start, s.end, s.kind) for s in out.spans if s.kind_no == 3] == [(4, 4 + len(secrets[2]), "markov")]


def brute_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                part = w[s:i + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((s, i + q - s, q))
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(rng, n, kinds):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 3:
            at = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - at) // 2 + 1))
            for i in range(at, rng.randint(at, n)):
                w[i] = w[at + (i - at) % p]
    return w


@pytest.mark.parametrize("base_octave", [11, 2, 0])
def test_tiles_find_every_run(base_octave, monkeypatch):
    rng = random.Random(base_octave)
    for trial in range(120):
        if trial == 100:  # hashes that lie: settled by exact numbers
            monkeypatch.setattr(periodic.Levels, "_mix", staticmethod(lambda a, b: (a + b) % np.uint64(3)))
        w = periodic_words(rng, rng.choice([0, 5, 12, 13, 40, 150, 400]), rng.choice([1, 2, 3, 50]))
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        tiles = periodic.tiles_of(len(w), 12, base_octave)
        pieces = set()
        if tiles:
            ids = np.array([number[x] for x in w], np.int32)
            t, s, e, q = periodic.solve_tiles([ids[a:z] for *_, a, z in tiles], [(lo, hi) for lo, hi, _, _ in tiles], 12)
            pieces = {(int(c), int(a) + tiles[k][2], int(b) + tiles[k][2]) for k, a, b, c in zip(t, s, e, q)}
        runs = []
        for q, a, b in sorted(pieces):
            if runs and runs[-1][0] == q and runs[-1][2] - a >= q:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([q, a, b])
        assert sorted((a, b - a, q) for q, a, b in runs) == brute_runs(w)


def test_collapse_runs(spark, edge, empty):
    rng = random.Random(8)
    texts = [" ".join(periodic_words(rng, rng.choice([0, 1, 11, 12, 60, 300]), rng.choice([1, 2, 4, 80]))) for _ in range(80)]
    texts += [None, "", " \n ", "a " * 3000, "\x1ca\x85b " * 20]
    docs = [(i, t, "x", 1, "y", "z", "w") for i, t in enumerate(texts)]
    docs += [docs[3], docs[-2], (None, texts[5], None, None, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    for options in ({}, {"base_octave": 1, "spread_bytes": 100}):
        out = periodic.collapse_runs(df, **options).collect()
        want = []
        for i, t, *_ in docs:
            w = brute.WORDS.findall(t or "")
            runs = brute_runs(w) if len(set(w)) > 1 or len(w) < 12 else [(0, len(w), 1)]
            want.append(str((i, runs, collapsed(w, runs))))
        assert sorted(str((r.id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed)) for r in out) == sorted(want)
    assert periodic.collapse_runs(edge).count() == edge.count() and periodic.collapse_runs(empty).count() == 0


def test_periodic_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for i, t in duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        w = brute.WORDS.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        number = dict(zip(dict.fromkeys(w), count()))
        runs = brute_runs([number[x] for x in w]) if n < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), brute.sha(collapsed(w, runs).encode())))
    ids = {x[0] for x in want}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect() if r.doc_id in ids]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 180
