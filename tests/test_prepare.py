import json

import pytest
from pyspark.sql import functions as F

from vqaframe.functions.strings import (
    REFERENCE_PROMPT,
    format_template,
    image_file_name,
    parse_template,
    path_join,
    zero_pad,
)
from vqaframe.operators import prepare as P
from vqaframe.sources.nested_json import read_annotations, read_questions


def test_parse_template_escapes_and_errors():
    assert parse_template("a {{x}} {} b") == ("a {x} ", " b")
    assert parse_template("{0}!") == ("", "!")
    for bad in ["no field", "{} {}", "{name}", "{:>5}", "{!r}"]:
        with pytest.raises(ValueError):
            parse_template(bad)
    pre, suf = parse_template(REFERENCE_PROMPT)
    assert pre.startswith('"Answer') and pre.endswith("\\n") and suf == '"'


def test_format_template_keeps_braces_in_values(spark):
    rows = [("q {} {x} % 'quote' é",), (None,)]
    df = spark.createDataFrame(rows, "question string")
    out = df.select(format_template("Q: {}?", "question").alias("p")).collect()
    assert out[0]["p"] == "Q: q {} {x} % 'quote' é?"
    assert out[1]["p"] is None
    assert "Q: {}?".format(rows[0][0]) == out[0]["p"]


def test_zero_pad_and_file_name(spark):
    df = spark.createDataFrame([(1,), (123456789012,), (1234567890123,)], "id long")
    got = [r[0] for r in df.select(image_file_name(F.col("id"), "val")).collect()]
    expect = ["COCO_val2014_{}.jpg".format("0" * (12 - len(str(i))) + str(i))
              for i in (1, 123456789012, 1234567890123)]
    assert got == expect
    assert [r[0] for r in df.select(zero_pad("id", 3)).collect()][0] == "001"


@pytest.mark.parametrize("d,expect", [("", "x.jpg"), ("imgs", "imgs/x.jpg"), ("imgs/", "imgs/x.jpg")])
def test_path_join(spark, d, expect):
    df = spark.createDataFrame([("x.jpg",)], "n string")
    assert df.select(path_join(d, F.col("n"))).first()[0] == expect


def _write_json(path, obj, pretty):
    with open(path, "w") as f:
        json.dump(obj, f, indent=2 if pretty else None)


def _fixtures(tmp):
    ann = {"annotations": [
        {"question_id": 1, "image_id": 9, "question_type": "what", "answer_type": "other",
         "multiple_choice_answer": "cat", "answers": [{"answer": "cat"}]},
        {"question_id": 1, "image_id": 9, "question_type": "what", "answer_type": "other",
         "multiple_choice_answer": "kitten", "answers": []},
        {"question_id": 2, "image_id": 12, "question_type": "how", "answer_type": "number",
         "multiple_choice_answer": "2", "answers": []},
        {"question_id": 7, "image_id": 5, "question_type": "x", "answer_type": "y",
         "multiple_choice_answer": "orphan", "answers": []},
        {"question_id": None, "image_id": 5, "question_type": "x", "answer_type": "y",
         "multiple_choice_answer": "nullkey", "answers": []},
    ]}
    qs = {"questions": [
        {"question_id": 1, "image_id": 9, "question": "What {} is {x}?"},
        {"question_id": 2, "image_id": 123456789012, "question": "How many 100%?"},
        {"question_id": 3, "image_id": 1234567890123, "question": None},
        {"question_id": None, "image_id": 1, "question": "null key"},
    ]}
    _write_json(f"{tmp}/ann.json", ann, pretty=True)
    _write_json(f"{tmp}/q.json", qs, pretty=False)
    _write_json(f"{tmp}/empty.json", {"annotations": []}, pretty=True)
    return ann, qs


def test_nested_json_scan_pretty_and_single_line(spark, tmp):
    _fixtures(tmp)
    a = read_annotations(spark, [f"{tmp}/ann.json", f"{tmp}/empty.json"])
    q = read_questions(spark, f"{tmp}/q.json")
    assert a.count() == 5 and q.count() == 4
    assert set(a.columns) >= {"question_id", "multiple_choice_answer", "answers"}


def test_strict_drop_missing_column_fails(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(KeyError):
        P.strict_drop(df, ["a", "zzz"])
    assert P.rename(df, {"zzz": "y", "a": "x"}).columns == ["x", "b"]


def test_join_many_to_many_and_null_keys(spark, tmp):
    _fixtures(tmp)
    a = read_annotations(spark, f"{tmp}/ann.json")
    q = read_questions(spark, f"{tmp}/q.json")
    j = P.join_questions_annotations(q, a)
    got = sorted((r["question_id"], r["answer"]) for r in j.collect())
    assert got == [(1, "cat"), (1, "kitten"), (2, "2")]
    assert set(j.columns) == {"question_id", "image_id", "question", "answer"}
    ns = P.join_questions_annotations(q, a, null_safe=True)
    assert ns.count() == 4  # pandas-style: null keys match each other


def test_build_qa_dataset_end_to_end(spark, tmp):
    _fixtures(tmp)
    a = read_annotations(spark, f"{tmp}/ann.json")
    q = read_questions(spark, f"{tmp}/q.json")
    ds = P.build_qa_dataset(q, a, "train", "imgs", template="Q: {}")
    rows = {r["answer"]: r for r in ds.collect()}
    assert rows["cat"]["question"] == "Q: What {} is {x}?"
    assert rows["2"]["image_file"] == "imgs/COCO_train2014_123456789012.jpg"
    assert rows["2"]["split"] == "train" and rows["2"]["img_path"] == "imgs"
    one = P.build_qa_dataset(q, a, "train", "imgs", template="Q: {}", fraction=0.34)
    assert one.count() == int(0.34 * 3)
    none = P.build_qa_dataset(q, a, "train", "imgs", fraction=0.0)
    assert none.count() == 0
    with pytest.raises(ValueError):
        P.build_qa_dataset(q, a, "train", "imgs", fraction=1.5).count()
