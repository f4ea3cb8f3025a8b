"""Token counts of whole texts for a word-level BPE tokenizer file.

Method: whole-token shortcut. Offline, every vocabulary string that ends a word is run through the
merges once; those that come out as one token are proved whole. Texts are split into pre-tokens, a
pre-token in that set counts one, and only the rest is merged (by the library's merge model; results
of short ones are remembered in a bounded table). Special strings count one each, as the library does.

The tokenizer file is read on the driver, and its text and the proved strings are broadcast: their size
is that of one vocabulary. Documents are not shuffled.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vqaframe.llm.common import python_ready
from vqaframe.llm.pretokens import Memo, WordSplitter, from_symbols, to_symbols

_WORKER: dict = {}


def prove_whole_tokens(tok: Tokenizer, suffix: str = "</w>") -> list[str]:
    """The vocabulary strings that, as a whole pre-token, encode to exactly themselves."""
    out = []
    for piece in tok.get_vocab(with_added_tokens=False):
        if not piece.endswith(suffix):
            continue
        symbols = piece[:-len(suffix)]
        got = tok.model.tokenize(symbols) if symbols else []
        text = from_symbols(symbols) if len(got) == 1 and got[0].value == piece else None
        if text is not None:
            out.append(text)
    return out


class Counter:
    def __init__(self, tok: Tokenizer, whole: list[str]):
        self.splitter = WordSplitter(tok)
        model = tok.model
        self.counts = Memo(lambda p: len(model.tokenize(to_symbols(p))), dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        parts = self.splitter.segments(text)
        get = self.counts.__getitem__
        return len(parts) // 2 + sum(sum(map(get, self.splitter.split(p))) for p in parts[::2] if p)


def _counter(content: str, whole: list[str]) -> Counter:
    key = ("count", hashlib.sha256(content.encode()).hexdigest())
    if key not in _WORKER:
        _WORKER[key] = Counter(Tokenizer.from_str(content), whole)
    return _WORKER[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = 2048) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``max_tokens``)."""
    spark = docs.sparkSession
    python_ready(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    known = spark.sparkContext.broadcast((content, prove_whole_tokens(Tokenizer.from_str(content))))
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def work(batches):
        counter = _counter(*known.value)
        for b in batches:
            n = [counter.count(t) for t in b.column(1).to_pylist()]
            size = pa.array([len(t) for t in b.column(1).cast(pa.large_binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = base.mapInArrow(work, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
