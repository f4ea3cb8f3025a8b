import gzip
import math
import os
import random

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from test_text_operators import check_packing
from vqaframe.llm import oracle, topk, warc_audit


def brute_top(rows, is_query, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if is_query(q):
            s = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 20])
def test_top_k(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.001, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 200)]  # ties beyond k
    rows += [(200, None), (210, [None] * 6), (220, [float("nan")] * 6), (230, [float("inf")] + [0.0] * 5), (240, [0.5, 0.5]),
             (250, [1.0, -1.0]), (260, []), (270, [1e15] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = topk.top_k(df, F.col("id") % 10 == 0, k=10, query_block=block)
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in out.collect()) == brute_top(rows, lambda i: i % 10 == 0, 10)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.id) for r in topk.top_k(df, F.col("id") == 0).collect()] == [(0, 1)]
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    rows = [(i, f"http://x/{i}", f"<p>päge {i}</p>\r\n\r\n" * (i % 5)) for i in range(70)] + [(None, None, None), (3, "a\r\nb", "WARC/1.0\r\n")] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_intact_archive(spark, pages):
    out = warc_audit.audit(pages, per_file=20).collect()
    assert len(out) == 74 and all(r.intact for r in out)
    assert warc_audit.audit(pages.limit(0)).count() == 0


def test_damage_is_located(spark, pages):
    hurt = F.xxhash64("record").bitwiseAND(7) == 0
    bad = {(r.file, r.place) for r in warc_audit.records(pages, per_file=20).filter(hurt).collect()}
    for change in (F.concat("record", F.lit("!")), F.regexp_replace("record", "Content-Type", "Content-type")):
        out = warc_audit.audit(pages, F.when(hurt, change).otherwise(F.col("record")), per_file=20).collect()
        assert bad and {(r.file, r.place) for r in out if not r.intact} == bad



def test_damage_of_stored_bytes(spark, pages, tmp_path):
    recs = warc_audit.records(pages, per_file=20)
    warc_audit.write_archive(recs, str(tmp_path / "a"))
    source = warc_audit.leaves_of_records(recs)
    found = sorted((tmp_path / "a").glob("file=*/part-*"))
    names = [int(f.parent.name[5:]) for f in found]

    def replica(name, **changed):  # without the local checksums
        for f, n in zip(found, names):
            to = tmp_path / name / f.parent.name
            to.mkdir(parents=True)
            (to / f.name).write_bytes(changed["change"](f.read_bytes()) if n == names[0] else f.read_bytes())
        return str(tmp_path / name)

    def differing(path):
        rows = warc_audit.compare(source, warc_audit.leaves_of_archive(spark, path), 20).collect()
        two = warc_audit.audit_replicas(spark, str(tmp_path / "a"), path, 20).collect()
        bad = sorted((r.file, r.place) for r in rows if not r.intact)
        assert bad == sorted((r.file, r.place) for r in two if not r.intact) and len(rows) == len(two)
        return bad, len(rows)

    data = found[0].read_bytes()
    parts = [(a, z) for _, a, z in warc_audit.members(data)]
    n = len(parts) - 1  # the last is empty
    assert gzip.decompress(data) and n > 5 and differing(replica("same", change=lambda x: x)) == ([], 74)
    for bit in (3, (parts[2][1] - parts[2][0]) * 4, (parts[2][1] - parts[2][0]) * 8 - 50):  # its start, middle, checksum
        at = parts[2][0] + bit // 8
        flipped = data[:at] + bytes([data[at] ^ 1 << bit % 8]) + data[at + 1:]
        assert differing(replica(f"flip{bit}", change=lambda _: flipped)) == ([(names[0], 2)], 74)
    hole = data[:parts[1][0] + 30] + bytes(parts[3][0] + 30 - parts[1][0] - 30) + data[parts[3][0] + 30:]
    assert differing(replica("hole", change=lambda _: hole))[0][0] == (names[0], 1)
    cut = differing(replica("cut", change=lambda x: x[:parts[4][0] + 40]))
    assert cut == ([(names[0], i) for i in range(4, n)], 74)
    more = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert differing(replica("more", change=lambda x: x + more)) == ([(names[0], n)], 75)
    path = replica("file", change=lambda x: x)
    (tmp_path / "file" / "file=999").mkdir()
    (tmp_path / "file" / "file=999" / "part-0").write_bytes(more * 2)
    assert differing(path) == ([(999, 0), (999, 1)], 76)


def test_pages_are_read_once(spark, pages):
    # a source that gives other records each time it is read, as a scan that is split otherwise does
    other = F.udf(lambda _: os.urandom(8).hex(), "string").asNondeterministic()
    out = warc_audit.audit(pages.withColumn("url", other("url")), per_file=20).collect()
    assert len(out) == 74 and all(r.intact for r in out)

def test_split_records_of_odd_bytes():
    one = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc_audit.split_records(one * 2) == [(0, len(one)), (len(one), len(one))]
    assert warc_audit.split_records(b"") == []
    assert warc_audit.split_records(b"junk" + one[:20])[0][0] == 0


def run_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before
        yield docs


def test_pipeline_equals_plain_python(spark):
    src = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{src}'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({oracle.QUALITY})").fetchall() if k}
    docs = [(i, t) for i, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in kept]
    docs = [(i, t) for i, _, _, t in brute.line_dedup(docs)]
    group = brute.components([brute.simhash(t) for _, t in docs])
    docs = [d for d, g in zip(docs, group) if docs[g] == d]
    left = brute.passages_kept_once([t.encode() for _, t in docs], 200)
    docs = [(i, x[1].decode("utf-8", "ignore")) for (i, _), x in zip(docs, left) if not x[0] or x[1].split()]
    *_, before, rows = run_stages(spark, spark.read.parquet(src))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in before.collect()) == sorted((i, t, len(t)) for i, t in docs)
    check_packing(rows.collect(), docs)


def test_passage_stage_keeps_one_copy_and_drops_emptied_documents(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    docs = [(1, f"first {passage} end", 0), (2, f"second {passage} other", 0), (3, passage, 0), (4, "clean text", 0), (5, "", 0), (6, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.passage_dedup(spark, df, "").collect()}
    assert out == {1: (docs[0][1], len(docs[0][1])), 2: ("secondother", 11), 4: ("clean text", 10), 5: ("", 0), 6: ("", 0)}


def test_pipeline_on_edge_rows(spark, edge, empty):
    assert [d.count() for d in run_stages(spark, empty)] == [0] * 5
    rows = edge.select("doc_id", "text", "row").collect()
    quality_rules, lines, near, passages, packing_stage = (f for _, f in corpus_pipeline.STAGES)
    passed = {r.row for r in rows if not brute.base_stats(r.text)[-1]}
    assert {r.row for r in quality_rules(spark, edge, "").collect()} <= passed
    want = brute.line_dedup([(r.doc_id, r.text) for r in rows])
    assert sorted(str((r.doc_id, r.text)) for r in lines(spark, edge, "").collect()) == sorted(str((i, t)) for i, _, _, t in want)
    assert near(spark, edge, "").count() == len(set(brute.components([brute.simhash(r.text) for r in rows])))
    left = passages(spark, edge, "").collect()
    assert all(r.n_chars == len(r.text) for r in left) and {r.row for r in rows if not (r.text or "").strip(" \n\t")} <= {r.row for r in left}
    packed = packing_stage(spark, edge, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows} and all(0 < r.length <= 1024 for r in packed)


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 0
