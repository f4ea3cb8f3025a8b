"""JSON documents whose records sit in an array under one field.

A VQA annotation file is a single JSON object, so a JSON reader makes the whole file one value and one task. Here
a file is read in byte ranges, a task each:

1. A range alone can't tell whether it begins inside a string. Each is summarised for all four states that it may
   begin in (in a string or not, after a backslash or not): the state it ends in and how much deeper. The summaries, a
   few numbers a range, are combined file by file from front to back, which gives every range its true state.
2. With it, each range emits what is at depth 1 (the field names), with nested values left out; file by file this tells
   which nested value is the wanted field. It also emits the parts of records (objects at depth 3) that its ends cut;
   they are joined by file and first range.
3. Each range emits the text of the field's records that lie in it, and texts become rows with ``from_json``.

Only rows of a few numbers per range are joined or moved; the file is read anew in each step.

A file that ends inside a string or a bracket, a record that doesn't parse, and a file without the field fail the read.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vqaframe.session import reliable_checkpoint, ship_package
from vqaframe.sources.ranges import byte_ranges, locate, pack_filesystem

ANNOTATION_RECORD = StructType([
    StructField("question_id", LongType()),
    StructField("image_id", LongType()),
    StructField("question_type", StringType()),
    StructField("answer_type", StringType()),
    StructField("multiple_choice_answer", StringType()),
    StructField("answers", ArrayType(StructType([StructField("answer", StringType())]))),
])
QUESTION_RECORD = StructType([
    StructField("question_id", LongType()),
    StructField("image_id", LongType()),
    StructField("question", StringType()),
])

_STATES = [(0, 0), (0, 1), (1, 0), (1, 1)]  # (in a string, after a backslash)
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[ord(c) for c in "{["]] = 1
_DEEPER[[ord(c) for c in "}]"]] = -1


def _structure(data: bytes, in_string: int, escaped: int):
    """(depth change of each byte, counted outside strings; whether each byte is in a string or a quote; end state)."""
    t = np.frombuffer(data, np.uint8)
    slash = t == ord("\\")
    # a byte is escaped if the run of backslashes before it is odd; the state carries a run from the range before
    at = np.arange(len(t))
    run_start = np.maximum.accumulate(np.where(slash, -1, at)) if len(t) else at  # last byte that is no backslash
    run = np.r_[0, at - run_start][:-1] if len(t) else at
    first = np.r_[-1, run_start][:-1] < 0 if len(t) else at
    escape = (run + np.where(first, escaped, 0)) % 2 == 1
    quote = (t == ord('"')) & ~escape
    inside = (np.cumsum(quote) + in_string) % 2 == 1
    quoted = inside | quote
    end_run = int(at[-1] - run_start[-1]) if len(t) else 0
    whole = len(t) == end_run
    return np.where(quoted, 0, _DEEPER[t]), quoted, (int(inside[-1]) if len(t) else in_string,
                                                     (end_run + (escaped if whole else 0)) % 2)


_SUMMARY = "path string, chunk int, ends array<int>"


def _summaries(batches):
    """For each state that a range may begin in: in a string, after a backslash, depth change at its end."""
    for b in batches:
        ends = []
        for data in b.column("data").to_pylist():
            row = []
            for state in _STATES:
                depth, _, end = _structure(data, *state)
                row += [*end, int(depth.sum())]
            ends.append(row)
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("chunk"), pa.array(ends, pa.list_(pa.int32()))],
                                         ["path", "chunk", "ends"])


def _combined(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state that each range of one file begins in."""
    ranges = ranges.sort_values("chunk")
    state, depth, out = (0, 0), 0, []
    for chunk, ends in zip(ranges["chunk"], ranges["ends"]):
        out.append((ranges["path"].iloc[0], chunk, *state, depth))
        a, b, more = ends[3 * _STATES.index(state):][:3]
        state, depth = (int(a), int(b)), depth + int(more)
    if state != (0, 0) or depth:
        raise ValueError(f"malformed JSON: {ranges['path'].iloc[0]} ends at depth {depth} or inside a string")
    return pd.DataFrame(out, columns=["path", "chunk", "in_string", "escaped", "depth"])


_STATE = "path string, chunk int, in_string int, escaped int, depth int"
_PART = "path string, chunk int, kind string, opened int, text binary"


def _levels(data: bytes, in_string: int, escaped: int, depth: int):
    """(depth before each byte, after it, nested values of the file's object begun so far, begins and ends of records)."""
    change, _, _ = _structure(data, in_string, escaped)
    level = depth + np.cumsum(change, dtype=np.int64)
    before = level - change
    opened = np.cumsum((before == 1) & (level == 2))
    return before, level, opened, np.flatnonzero((before == 2) & (level == 3)), np.flatnonzero((before == 3) & (level == 2)) + 1


def _parts(data: bytes, in_string: int, escaped: int, depth: int):
    """(kind, opened, text): the parts of records cut by the range's ends, and the text at depth 1.

    ``opened``: nested values that have begun in the range up to there. A nested value stands as one NUL byte in
    the text at depth 1, which holds no other.
    """
    before, level, opened, begins, closes = _levels(data, in_string, escaped, depth)
    if depth >= 3:  # a record goes on from the range before
        yield "ends" if len(closes) else "goes on", 0, data[:int(closes[0]) if len(closes) else len(data)]
        closes = closes[1:]
    if len(begins) > len(closes):
        yield "begins", int(opened[begins[-1]]), data[int(begins[-1]):]
    starts = (before == 1) & (level == 2)
    top = np.where(starts, 0, np.frombuffer(data, np.uint8))[((before <= 1) & (level <= 1)) | starts]
    yield "top", int(opened[-1]) if len(opened) else 0, top.astype(np.uint8).tobytes()


def _records(data: bytes, in_string: int, escaped: int, depth: int, earlier: int, wanted: list[int]):
    """Texts of the records in the range, of the wanted nested values."""
    _, _, opened, begins, closes = _levels(data, in_string, escaped, depth)
    for a, z in zip(begins, closes[1:] if depth >= 3 else closes):
        if earlier + opened[a] in wanted:
            yield data[a:z].decode()


def _field_values(ranges: pd.DataFrame, field: str) -> pd.DataFrame:
    """For each range of one file: nested values begun before it, and which of them (from 1) are under ``field``."""
    ranges = ranges.sort_values("chunk")
    top = b"".join(ranges["text"]).decode().replace("\0", "\"\\u0000\"")
    pairs = json.loads(top, object_pairs_hook=list)
    keys = [k for k, v in pairs if v == "\0"] if isinstance(pairs, list) else []
    wanted = [i + 1 for i, k in enumerate(keys) if k == field]
    if not wanted:
        raise ValueError(f"{ranges['path'].iloc[0]}: a document has no field {field}")
    earlier = ranges["opened"].cumsum() - ranges["opened"]
    return pd.DataFrame({"path": ranges["path"], "chunk": ranges["chunk"], "earlier": earlier, "wanted": [wanted] * len(ranges)})


def read_nested_json(spark: SparkSession, paths, field: str, record: StructType, range_bytes: int = 32 * 1024 * 1024,
                     filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """One row per record (object) in the array ``field``, across all files in ``paths``.

    Each range of ``range_bytes`` is a task. A malformed file, or one without the field, fails the read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    packed = pack_filesystem(filesystem)
    ranges = byte_ranges(spark, paths, range_bytes, filesystem)
    states = reliable_checkpoint(ranges.mapInArrow(_summaries, _SUMMARY).groupBy("path").applyInPandas(_combined, _STATE))
    tasks = max(1, states.count())

    def data_of(path: str, chunk: int) -> bytes:
        opened, inside = locate(path, packed)
        with opened.open_input_file(inside) as f:
            return f.read_at(range_bytes, chunk * range_bytes)

    def parts(batches):
        for b in batches:
            for path, chunk, *state in zip(*[c.to_pylist() for c in b.columns], strict=True):
                kind, opened, text = zip(*_parts(data_of(path, chunk), *state), strict=True)
                n = len(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array([chunk] * n, pa.int32()), pa.array(kind), pa.array(opened, pa.int32()),
                     pa.array(text, pa.binary())], ["path", "chunk", "kind", "opened", "text"])

    def whole(batches):
        for b in batches:
            for path, chunk, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(list(_records(data_of(path, chunk), *rest)), pa.string())], ["text"])

    cut = reliable_checkpoint(states.repartition(tasks).mapInArrow(parts, _PART))
    values = cut.filter("kind = 'top'").groupBy("path").applyInPandas(
        lambda pdf: _field_values(pdf, field), "path string, chunk int, earlier int, wanted array<int>")
    starts = reliable_checkpoint(states.join(values, ["path", "chunk"]).select(*states.columns, "earlier", "wanted"))

    cut = cut.filter("kind <> 'top'")
    order = F.when(F.col("kind") == "begins", F.lit(1)).otherwise(F.lit(0))  # what goes on comes first in a range
    so_far = Window.partitionBy("path").orderBy("chunk", order)
    cut = cut.withColumn("first", F.last(F.when(F.col("kind") == "begins", F.col("chunk")), True).over(so_far))
    joined = cut.groupBy("path", F.col("first").alias("chunk")).agg(
        F.max("opened").alias("opened"),  # 0 in the parts that go on
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"].cast("string")), "").alias("text"))
    joined = joined.join(starts, ["path", "chunk"])
    ours = F.array_contains("wanted", F.col("earlier") + F.col("opened"))
    # null where it isn't ours: a caller's filter may be evaluated before this one, and other values need not parse
    joined = joined.filter(ours).select(F.when(ours, F.col("text")).alias("text"))
    texts = starts.repartition(tasks).mapInArrow(whole, "text string").unionByName(joined)
    return texts.select(F.from_json("text", record, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_nested_json(df: DataFrame, directory: str, field: str, filesystem: pafs.FileSystem | None = None) -> list[str]:
    """Write the rows as JSON objects ``{"info": ..., field: [records]}``, one file per partition; returns the paths.

    A file is named by its partition, so a task that runs again writes the same file again.
    """
    packed = pack_filesystem(filesystem)
    head = json.dumps({"info": {"version": "1.0", "note": "records, \"quoted\" \\ {[braced]}"}})[:-1] + f", {json.dumps(field)}: ["

    def work(batches):
        from pyspark import TaskContext
        path = f"{directory}/part-{TaskContext.get().partitionId():05d}.json"
        fs, inside = locate(path, packed)
        fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        n = 0
        with fs.open_output_stream(inside) as f:
            f.write(head.encode())
            for b in batches:
                for line in b.column(0).to_pylist():
                    f.write((",\n" if n else "").encode() + line.encode())
                    n += 1
            f.write(b"]}")
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    ship_package(df.sparkSession)
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))
    return [r["path"] for r in lines.mapInArrow(work, "path string").collect()]


def read_annotations(spark: SparkSession, paths, **kw) -> DataFrame:
    return read_nested_json(spark, paths, "annotations", ANNOTATION_RECORD, **kw)


def read_questions(spark: SparkSession, paths, **kw) -> DataFrame:
    return read_nested_json(spark, paths, "questions", QUESTION_RECORD, **kw)
