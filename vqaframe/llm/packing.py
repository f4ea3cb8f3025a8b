"""Best-fit packing of token sequences under several capacities.

Method: vector best-fit. Every open sequence has residual capacities: tokens, documents and attention
cost (the sum of squared piece lengths). A piece goes to an open sequence where it fits in every
dimension, chosen by the smallest weighted norm of what would remain (``rule="norm"``) or by the largest
weighted dot product of its demand with what is left (``rule="dot"``); if none fits, a new one opens. Document
count and attention weigh a tenth of the tokens by default: where sequences leave nearly the same room in tokens, the
one with less of the others to spare is taken, and full ones close sooner.
Pieces are taken longest first.

Documents are tokenised in place; only lengths and checksums move. Pieces that fill a sequence alone get
theirs at once. The others are dealt round-robin into groups of about ``group_size`` pieces, each packed
by one task, so a group's size is bounded whatever the keys. A group leaves a few sequences part-filled:
their share shrinks as 1 / group size.

Defined results: a null or empty text still holds the end id; repeated rows are packed one by one; a
piece over the attention capacity alone raises; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vqaframe.llm.common import materialise, python_ready
from vqaframe.llm.pretokens import Memo, SpaceSplitter, to_symbols

_WORKER: dict = {}
_CODEC = "<I"  # unsigned, little-endian, 32 bits


class Encoder:
    """Ids of a text as packed 32-bit numbers, remembered by pre-token."""

    def __init__(self, tok: Tokenizer):
        self.splitter = SpaceSplitter(tok)
        model = tok.model
        ids = {i: pack(_CODEC, i) for i in tok.get_vocab().values()}
        self.packed = Memo(lambda p: b"".join([ids[t.id] for t in model.tokenize(to_symbols(p))]), limit=500_000)
        self.special = {s: pack(_CODEC, i) for s, i in self.splitter.special_ids.items()}

    def encode(self, text: str) -> bytes:
        get, out = self.packed.__getitem__, []
        for i, part in enumerate(self.splitter.segments(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(map(get, self.splitter.split(part)))
        return b"".join(out)


def _encoder(content: str) -> Encoder:
    key = ("encode", hashlib.sha256(content.encode()).hexdigest())
    if key not in _WORKER:
        _WORKER[key] = Encoder(Tokenizer.from_str(content))
    return _WORKER[key]


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole pieces at the end, the rest (if any) first."""
    first = n if n <= most else n % most or most
    return [(0, first)] + [(a, most) for a in range(first, n, most)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, most: int,
                     end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    spark = docs.sparkSession
    python_ready(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        known = spark.sparkContext.broadcast(f.read())
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    end = pack(_CODEC, end_id)

    def work(batches):
        encoder = _encoder(known.value)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                for k, (a, n) in enumerate(cut_pieces(len(ids) // 4, most)):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * a:4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    return base.mapInArrow(work, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, caps: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. caps: tokens, documents and attention cost of a sequence."""
    n = len(lengths)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return seq, offset
    if lengths.max() > caps[0] or int(lengths.max()) ** 2 > caps[2] or caps[1] < 1:
        raise ValueError("a piece exceeds a capacity by itself")
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min())
    cap = np.array(caps, np.float64)
    w = np.array(weights)
    left = np.empty((max(16, n), 3))  # what is left in the open sequences, and their numbers
    number = np.empty(len(left), np.int64)
    n_open = n_all = 0
    for i in order:
        size = float(lengths[i])
        need = np.array((size, 1.0, size * size))
        room = left[:n_open]
        fits = np.flatnonzero((room[:, 0] >= need[0]) & (room[:, 1] >= 1) & (room[:, 2] >= need[2]))
        if len(fits):
            rest = (room[fits] - need) / cap if rule == "norm" else room[fits] / cap
            score = (rest * rest) @ w if rule == "norm" else -(rest @ (w * need / cap))
            at = int(fits[np.argmin(score)])
        else:
            at, n_open = n_open, n_open + 1
            left[at], number[at] = cap, n_all
            n_all += 1
        seq[i], offset[i] = number[at], cap[0] - left[at, 0]
        left[at] -= need
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:  # nothing more can fit: close it
            n_open -= 1
            left[at], number[at] = left[n_open], number[n_open]
    return seq, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = 1024, max_docs: int = 1024, max_attention: int = 1024 * 1024, end_id: int = 2,
                   weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm",
                   group_size: int = 16384) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, id_col, text_col, max_tokens, end_id), "packing-pieces")
    full = pieces.filter(F.col("length") == max_tokens).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    rest = pieces.filter(F.col("length") < max_tokens)
    groups = max(1, -(-rest.count() // group_size))
    caps = (max_tokens, max_docs, max_attention)

    def work(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        seq, offset = best_fit(t.column("length").to_numpy(), caps, weights, rule)
        seq += TaskContext.get().partitionId() << 33
        yield from t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset)).to_batches()

    packed = rest.repartition(groups).mapInArrow(
        work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema))
    return full.unionByName(packed)
