import io
import json
import math
import os
import random
import zipfile

import pytest

from vqaframe.functions.parse import python_float
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from vqaframe.plans import tables as T
from vqaframe.sources import archives, dataset_io, images, metric_lines as ML
from vqaframe.sources import nested_json as NJ

LINES = ["0.5", " 0.25 ", "1e-1", "abc", "", "1.5d", "1_000", "nan", "inf", "-Infinity",
         ".5", "5.", "1__0", "_1", "0x10", "+1E+2", "\t7\n", "+nan", "-NaN", "+inf", "1e1_0"]


def py_float(s):
    try:
        return float(s.strip())
    except ValueError:
        return None


def test_python_float_rules(spark):
    df = spark.createDataFrame([(s,) for s in LINES], "line string")
    got = [r[0] for r in df.select(python_float("line")).collect()]
    for s, g in zip(LINES, got):
        e = py_float(s)
        if e is None:
            assert g is None, s
        elif math.isnan(e):
            assert math.isnan(g), s
        else:
            assert g == e, s


def test_metric_lines_roundtrip_and_consume(spark, tmp):
    d = f"{tmp}/lines"
    vals = spark.createDataFrame([(0, 0.5), (0, 0.25), (1, 1.0)], "rank int, value double")
    ML.append_metric_lines(vals, d)
    ML.append_metric_lines(spark.createDataFrame([(1, "junk")], "rank int, value string"), d)
    lines = ML.read_metric_lines(spark, d)
    per = {r["rank"]: r for r in ML.mean_of_lines(lines, by_rank=True).collect()}
    assert per[0]["n_values"] == 2 and per[1]["n_values"] == 1
    overall = ML.mean_of_lines(lines).first()
    assert abs(overall["mean_value"] - 1.75 / 3) < 1e-12
    there = sum(f.endswith(".txt") for _, _, files in os.walk(d) for f in files)
    consumed = ML.consume_lines(spark, d, archive_dir=f"{tmp}/archive/lines")
    assert consumed.count() == 4
    assert not [f for _, _, files in os.walk(d) for f in files if f.startswith("part-") and f.endswith(".txt")]
    assert sum(f.endswith(".txt") for _, _, files in os.walk(f"{tmp}/archive/lines") for f in files) == there
    assert ML.consume_lines(spark, d).count() == 0


def _lines(df):
    return sorted((r["rank"], r["line"], r["value"]) for r in df.collect())


def test_lines_that_arrive_during_a_read_wait_for_the_next(spark, tmp, monkeypatch):
    d = f"{tmp}/lines"
    add = lambda *rows: ML.append_metric_lines(spark.createDataFrame(rows, "rank int, value double"), d)
    add((0, 0.5), (1, 0.25))
    claim = ML.claim_lines(spark, d)
    add((1, 0.75))
    first = ML.read_claim(spark, d, claim)
    assert _lines(first) == [(0, "0.5", 0.5), (1, "0.25", 0.25)]
    assert _lines(ML.consume_lines(spark, d)) == [(1, "0.75", 0.75)]
    assert _lines(first) == [(0, "0.5", 0.5), (1, "0.25", 0.25)]  # written, so still there
    # a call that ends while files are moved away: the next one returns its lines, once
    add((2, 1.5), (3, 2.5))
    moves, rename = [], ML._rename

    def failing(fs, cls, source, target):
        if "/_claims/" not in source:
            moves.append(source)
            if len(moves) == 2:
                raise OSError("lost")
        rename(fs, cls, source, target)

    monkeypatch.setattr(ML, "_rename", failing)
    with pytest.raises(OSError):
        ML.consume_lines(spark, d, archive_dir=f"{tmp}/done")
    add((4, 3.5))
    monkeypatch.setattr(ML, "_rename", rename)
    assert _lines(ML.consume_lines(spark, d, archive_dir=f"{tmp}/done")) == [(2, "1.5", 1.5), (3, "2.5", 2.5), (4, "3.5", 3.5)]
    assert ML.consume_lines(spark, d).count() == 0 and ML.open_claims(spark, d) == []


def test_ragged_log_records(spark, tmp):
    history = [{"loss": 1.5, "step": 1}, {"eval": {"acc": 0.5, "tags": ["a", "b"]}, "note": "é \"q\"", "step": 2}, {"step": None, "ok": True}, {}]
    log = dataset_io.log_frame(spark, history)
    dataset_io.write_log(log, f"{tmp}/log")
    back = dataset_io.read_log(spark, f"{tmp}/log")
    texts = sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in back.select(F.to_json("record")).collect())
    assert texts == sorted(json.dumps({k: v for k, v in h.items() if v is not None}, sort_keys=True) for h in history)
    got = back.select(dataset_io.log_field("step", "bigint").alias("s"), dataset_io.log_field("eval.acc", "double").alias("a"),
                      dataset_io.log_field("eval.tags[1]", "string").alias("t"), dataset_io.log_field("note", "double").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, None, None), (2, 0.5, "b", None), (None,) * 4, (None,) * 4], key=str)


def test_no_values_anywhere_gives_zero(spark, tmp):
    d = f"{tmp}/empty_lines"
    ML.append_metric_lines(spark.createDataFrame([(0, "x"), (1, "")], "rank int, value string"), d)
    assert ML.mean_of_lines(ML.read_metric_lines(spark, d)).first()["mean_value"] == 0.0


def _zip_bytes(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in entries:
            if name.endswith("/"):
                z.writestr(zipfile.ZipInfo(name), b"")
            else:
                z.writestr(name, data)
    return buf.getvalue()


def test_archives_and_image_lookup(spark, tmp):
    os.makedirs(f"{tmp}/zips")
    with open(f"{tmp}/zips/a.zip", "wb") as f:
        f.write(_zip_bytes([("dir/", b""), ("dir/COCO_train2014_000000000001.jpg", b"abc"),
                            ("COCO_train2014_000000000002.jpg", b"xy"), ("../x", b"evil")]))
    out = archives.expand_archives(spark, [f"{tmp}/zips/a.zip", f"file:{tmp}/zips/gone.zip"])
    rows = out.collect()
    ok = sorted((r["entry"], r["length"]) for r in rows if r["error"] is None)
    assert ok == [("COCO_train2014_000000000002.jpg", 2), ("dir/COCO_train2014_000000000001.jpg", 3)]
    errs = sorted(r["error"] for r in rows if r["error"])
    assert errs == ["Zip file not found", "unsafe entry name"]
    os.makedirs(f"{tmp}/imgs/sub")
    for name, data in [("COCO_train2014_000000000001.jpg", b"abc"),
                       ("sub/COCO_train2014_000000000002.jpg", b"xy")]:
        with open(f"{tmp}/imgs/{name}", "wb") as f:
            f.write(data)
    listing = images.scan_images(spark, f"{tmp}/imgs")
    rows = spark.createDataFrame([(1, "COCO_train2014_000000000001.jpg"), (3, "COCO_train2014_000000000003.jpg")],
                                 "image_id long, image_file string")
    assert images.attach_images(rows, listing, on_missing="drop", name_col="file_name").count() == 1
    assert images.attach_images(rows, listing, on_missing="null", name_col="file_name").count() == 2
    assert [r["image_id"] for r in images.missing_images(rows, listing).collect()] == [3]
    matched = images.attach_images(rows, listing, on_missing="drop", name_col="file_name")
    with_bytes = images.attach_content(matched, images.scan_images(spark, f"{tmp}/imgs", with_content=True))
    assert [bytes(r["content"]) for r in with_bytes.collect()] == [b"abc"]
    with pytest.raises(Exception):
        images.attach_images(rows, listing, on_missing="error", name_col="file_name").collect()


def test_archived_and_plain_images_by_full_path(spark, tmp):
    """The same rows find plain files and archived ones, and the bytes of both reach them."""
    os.makedirs(f"{tmp}/plain")
    os.makedirs(f"{tmp}/packed/sub")
    with open(f"{tmp}/plain/1.jpg", "wb") as f:
        f.write(b"plain one")
    with open(f"{tmp}/packed/set.zip", "wb") as f:
        f.write(_zip_bytes([("set/", b""), ("set/1.jpg", b"archived one"), ("2.jpg", b"two"), ("/etc/x.jpg", b"no")]))
    files = images.scan_images(spark, f"{tmp}/plain", with_content=True).unionByName(
        images.archived_images(archives.expand_archives(spark, f"{tmp}/packed/set.zip"), with_content=True))
    rows = spark.createDataFrame([(1, f"{tmp}/plain/1.jpg"), (2, f"file:{tmp}/packed//set/1.jpg"), (3, f"{tmp}/packed/2.jpg"),
                                  (4, f"{tmp}/packed/set/2.jpg")], "id int, image_file string")
    matched = images.attach_images(rows, files.drop("content"), on_missing="null", name_col="path")
    got = {r["id"]: (r["content"] and bytes(r["content"]), r["image_bytes"]) for r in images.attach_content(matched, files).collect()}
    assert got == {1: (b"plain one", 9), 2: (b"archived one", 12), 3: (b"two", 3), 4: (None, None)}


def test_archives_through_another_file_system(spark, tmp):
    """No path of these archives is mounted; entries are dealt to tasks by bytes and read as ranges."""
    rng = random.Random(2)
    entries = [(f"d/{i}.bin", rng.randbytes(rng.randint(0, 3000))) for i in range(60)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i, (name, data) in enumerate(entries):
            z.writestr(name, data, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED][i % 2])
        z.writestr("odd.bin", b"x" * 50, zipfile.ZIP_BZIP2)
    os.makedirs(f"{tmp}/store")
    with open(f"{tmp}/store/a.zip", "wb") as f:
        f.write(buf.getvalue())
    at = buf.getvalue().index(entries[0][1]) + 5  # damage the first entry
    with open(f"{tmp}/store/b.zip", "wb") as f:
        f.write(buf.getvalue()[:at] + bytes([buf.getvalue()[at] ^ 1]) + buf.getvalue()[at + 1:])
    with open(f"{tmp}/store/c.zip", "wb") as f:
        f.write(b"no archive")
    store = pafs.SubTreeFileSystem(f"{tmp}/store", pafs.LocalFileSystem())
    out = archives.expand_archives(spark, ["a.zip", "b.zip", "c.zip", "d.zip"], partition_bytes=8000, batch_bytes=3000, filesystem=store)
    assert out.rdd.getNumPartitions() > 10
    rows = out.collect()
    good = {(r["archive"], r["entry"]): bytes(r["content"]) for r in rows if r["error"] is None}
    assert good == {(a, n): d for a in ("a.zip", "b.zip") for n, d in entries if (a, n) != ("b.zip", "d/0.bin")}
    errors = sorted((r["archive"], r["entry"], r["error"].split(":")[0]) for r in rows if r["error"] and r["entry"])
    assert errors == [("a.zip", "odd.bin", "unsupported method 12"), ("b.zip", "d/0.bin", "checksum differs"), ("b.zip", "odd.bin", "unsupported method 12")]
    assert {(r["archive"], r["error"].split(":")[0]) for r in rows if not r["entry"]} == {("c.zip", "bad archive"), ("d.zip", "Zip file not found")}


def test_archive_members_in_a_lateral_join(spark):
    df = spark.createDataFrame([(1, _zip_bytes([("a/", b""), ("a/x", b"12"), ("../y", b"3")])), (2, None), (3, b"junk"), (4, _zip_bytes([]))],
                               "id int, content binary")
    df.createOrReplaceTempView("rows_with_archives")
    name = archives.register_archive_members(spark)
    full = spark.sql(f"SELECT id, m.* FROM rows_with_archives t, LATERAL {name}(t.content, true) m")
    got = sorted(((r.id, r.entry, r.length, r.error and r.error.split(":")[0], r.content and bytes(r.content)) for r in full.collect()), key=str)
    assert got == [(1, "../y", None, "unsafe entry name", None), (1, "a/x", 2, None, b"12"), (3, None, None, "bad archive", None)]
    assert spark.sql(f"SELECT m.* FROM rows_with_archives t, LATERAL {name}(t.content, false) m").columns == ["entry", "length", "error"]


def test_rows_are_zipped_without_arrow_batches(spark):
    """An Arrow batch holds rows by number, not by bytes: a worker's memory would follow the texts."""
    df = spark.createDataFrame([(1, "u", "é" * 9), (2, None, ""), (3, "u", None)], "id int, url string, html string")
    df = df.select("id", T.zipped("url", "html").alias("content"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
            got[r.id] = {n: z.read(n).decode() for n in z.namelist()}
    assert got == {1: {"url.txt": "u", "html.txt": "é" * 9}, 2: {"url.txt": "", "html.txt": ""}, 3: {"url.txt": "u", "html.txt": ""}}


@pytest.mark.parametrize("size", [7, 100, 1_000_000])
def test_nested_json_in_ranges(spark, tmp, size):
    """Ranges that end anywhere: in strings, escapes, characters of several bytes, names and nested values."""
    rng = random.Random(3)
    recs = [{"question_id": i, "image_id": i * 7, "question": "".join(rng.choice('ab"\\{}[]:,é🙂 \n') for _ in range(rng.randint(0, 60)))}
            for i in range(12 if size == 7 else 120)]
    objects = [{"info": {"x": [1, {"q": "}"}]}, "license": 's"\\', "questions": recs, "other": [{"question_id": 9}], "n": 3},
               {"questions": []}, {"other": [{"question_id": 5}], "z": None, "questions": recs[:3]}]
    paths = []
    for k, o in enumerate(objects):
        paths.append(f"{tmp}/{k}.json")
        with open(paths[-1], "w") as f:
            json.dump(o, f, ensure_ascii=k == 0, indent=[None, None, 1][k])
    df = NJ.read_questions(spark, paths, range_bytes=size)
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r.values()) for r in recs + recs[:3])


@pytest.mark.parametrize("text", ['{"questions":[{"question_id":1}', '{"x":[]}', '{"questions":[{"question_id":"}]}', '{"questions":null}',
                                  '{"questions":[{"question_id":nope}]}'])
def test_malformed_nested_json_fails(spark, tmp, text):
    with open(f"{tmp}/bad.json", "w") as f:
        f.write(text)
    with pytest.raises(Exception):
        NJ.read_questions(spark, f"{tmp}/bad.json").collect()


def test_save_load_or_build_and_log(spark, tmp):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    built = []

    def build():
        built.append(1)
        return df

    p = f"{tmp}/ds"
    a = dataset_io.load_or_build(spark, p, build, partition_by=["split"])
    b = dataset_io.load_or_build(spark, p, build, partition_by=["split"])
    assert len(built) == 1 and sorted(tuple(r) for r in b.select("id", "split").collect()) == [(1, "train"), (2, "val")]
    assert a.count() == 2
    log = dataset_io.log_frame(spark, [{"loss": 1.0, "step": 1, "epoch": 0.1},
                                       {"eval_loss": 0.5, "step": 10, "epoch": 1.0}])
    dataset_io.write_log(log, f"{tmp}/log")
    recs = [json.loads(line) for fn in sorted(os.listdir(f"{tmp}/log")) if fn.startswith("part-")
            for line in open(f"{tmp}/log/{fn}")]
    assert {frozenset(r) for r in recs} == {frozenset({"loss", "step", "epoch"}),
                                             frozenset({"eval_loss", "step", "epoch"})}


def test_incomplete_dataset_is_built_anew(spark, tmp):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    p = f"{tmp}/part"
    df.filter("id = 1").write.partitionBy("split").parquet(p)
    os.remove(f"{p}/_SUCCESS")  # as a commit that ended in the middle
    ds = dataset_io.load_or_build(spark, p, lambda: df, partition_by=["split"])
    assert sorted(r.id for r in ds.collect()) == [1, 2]


def test_dataset_roundtrip_reuses_what_it_saved(spark, monkeypatch):
    from vqaframe.plans import queries
    monkeypatch.setattr(dataset_io, "path_exists", lambda *_: False)
    with pytest.raises(AssertionError, match="must be reused"):
        queries.q_dataset_roundtrip(spark, "/root/testdata/sf0.001")


def test_prepare_split_end_to_end(spark, tmp):
    from vqaframe.operators.dataset_build import prepare_split
    ann = {"annotations": [
        {"question_id": 1, "image_id": 1, "question_type": "a", "answer_type": "b",
         "multiple_choice_answer": "yes", "answers": []},
        {"question_id": 2, "image_id": 2, "question_type": "a", "answer_type": "b",
         "multiple_choice_answer": "no", "answers": []}]}
    qs = {"questions": [{"question_id": 1, "image_id": 1, "question": "Is it {a}?"},
                        {"question_id": 2, "image_id": 2, "question": "Two?"}]}
    for name, obj in [("ann.json", ann), ("q.json", qs)]:
        with open(f"{tmp}/{name}", "w") as f:
            json.dump(obj, f, indent=1)
    img = f"{tmp}/val2014"
    with open(img + ".zip", "wb") as f:
        f.write(_zip_bytes([("val2014/", b""), ("val2014/COCO_val2014_000000000001.jpg", b"1234"),
                            ("val2014/COCO_val2014_000000000002.jpg", b"12")]))
    out = prepare_split(spark, f"{tmp}/ann.json", f"{tmp}/q.json", f"{tmp}/saved", "val", img,
                        archive=True, template="Q: {}")
    rows = {r["question_id"]: r for r in out.collect()}
    assert rows[1]["question"] == "Q: Is it {a}?" and rows[1]["image_bytes"] == 4
    assert rows[2]["image_file"] == f"{img}/COCO_val2014_000000000002.jpg" and rows[2]["split"] == "val"
    again = prepare_split(spark, f"{tmp}/ann.json", f"{tmp}/q.json", f"{tmp}/saved", "val", img,
                          archive=True, load=True)
    assert again.count() == 2
    os.makedirs(f"{tmp}/plain")
    with open(f"{tmp}/plain/COCO_val2014_000000000001.jpg", "wb") as f:
        f.write(b"x")
    with pytest.raises(Exception):  # image 2 is missing: error by default
        prepare_split(spark, f"{tmp}/ann.json", f"{tmp}/q.json", f"{tmp}/saved2", "val",
                      f"{tmp}/plain")
    kept = prepare_split(spark, f"{tmp}/ann.json", f"{tmp}/q.json", f"{tmp}/saved3", "val",
                         f"{tmp}/plain", on_missing="drop")
    assert [r["question_id"] for r in kept.collect()] == [1]


def test_compute_accuracy_closure_flow(spark, tmp):
    preds = spark.createDataFrame(
        [(0, 0, [0.1, 0.9], 1), (0, 0, [0.8, 0.2], 1), (1, 1, [0.5, 0.4], 0), (1, 2, [0.1, 0.2], 0)],
        "rank int, batch_id long, logits array<double>, label int")
    d = f"{tmp}/store_values"
    per = ML.compute_accuracy(spark, d, preds.filter("batch_id = 0"))
    assert per.first()["eval_accuracy"] == 0.5
    ML.compute_accuracy(spark, d, preds.filter("batch_id > 0"))
    res = ML.compute_accuracy(spark, d, compute_result=True).first()["eval_accuracy"]
    assert abs(res - (0.5 + 1.0 + 0.0) / 3) < 1e-12
    left = [f for _, _, files in os.walk(d) for f in files if f.startswith("part-") and f.endswith(".txt")]
    assert not left  # consumed; the claim stays


def test_get_dataset_signature(spark, tmp):
    from vqaframe.operators.dataset_build import get_dataset
    ann = {"annotations": [{"question_id": i, "image_id": i, "question_type": "a", "answer_type": "b",
                            "multiple_choice_answer": str(i), "answers": []} for i in range(20)]}
    qs = {"questions": [{"question_id": i, "image_id": i, "question": f"q{i}"} for i in range(20)]}
    for name, obj in [("ann.json", ann), ("q.json", qs)]:
        with open(f"{tmp}/{name}", "w") as f:
            json.dump(obj, f)
    ds = get_dataset(spark, f"{tmp}/ann.json", f"{tmp}/q.json", "Q: {}", 0.29, split="train", img_path="i")
    rows = ds.collect()
    assert len(rows) == int(0.29 * 20) and all(r["question"].startswith("Q: q") for r in rows)
    assert {r["split"] for r in rows} == {"train"}


def test_rank_zero_empty_other_ranks_count(spark, tmp):
    d = f"{tmp}/ranks"
    ML.append_metric_lines(spark.createDataFrame([(0, "abc"), (1, "0.5"), (1, "1.0")],
                                                 "rank int, value string"), d)
    # the original returns 0 as soon as rank 0 has nothing; here every rank counts
    assert ML.mean_of_lines(ML.read_metric_lines(spark, d)).first()["mean_value"] == 0.75
