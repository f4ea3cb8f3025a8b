"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Method: the normaliser (spaces to the meta symbol, one in front), the pieces and the byte fallback are
compiled to transducer arcs; an input is composed with them and the shortest path in the tropical semiring
is its encoding.

A BPE model applies merges by score, so a path is right if and only if every piece on it is what its own
letters merge to and no merge crosses a border of two neighbours: a merge that crosses in the whole text
crosses in that pair alone, as what happens inside a piece before does not depend on its surroundings.
The arcs therefore run between states (place, last piece) and weigh minus the piece's score, or infinity
where the pair alone merges otherwise. At most one path of finite weight leads to a place: the encoding of
the text up to there. So the composition is expanded only on demand, depth first with the longest arc first:
the first path to reach the end is the shortest one, and a place without a way on is not entered again.
A pair is judged along the inner edges of its two merge trees: letters x (right edge of the first) and y
(left edge of the second) that exist at the same time merge if xy scores better than the merges that
would use up x or y. The encodings of short chunks are remembered.

No piece holds a meta symbol after another letter, nor a letter beside a digit, a sign or white space
(checked when compiled), so no merge crosses such a border, and the chunks between are composed on their own.

The compiled tables are broadcast (their size is the vocabulary's). Documents are not shuffled.

Defined results: a null or empty text has no ids; repeated rows give repeated rows. In decoding, control
ids give nothing, the unknown id its mark, and bytes that form no character U+FFFD.
"""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import python_ready
from vqaframe.llm.pretokens import Memo

META = "▁"
_WORKER: dict = {}


def _chunk_pattern(signs: str) -> str:
    """Meta symbols with the letters, or with the digits, signs and white space, that follow them.

    Words of A-Z and a-z only come first: the same chunks as by the second form, found faster.
    """
    signs = re.escape(signs.replace(META, ""))
    letter = rf"[^\W\d_{signs}]"
    return rf"{META}*[A-Za-z]++(?!{letter})|{META}*{letter}+|{META}*(?:(?!{META})[\W\d_{signs}])+|{META}+"


def compile_model(path: str) -> dict:
    """The arcs of a BPE model with byte fallback: pieces with score and id, byte ids, output of each id."""
    os.environ.setdefault("PROTOCOL_BUFFERS_PYTHON_IMPLEMENTATION", "python")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = pb.ModelProto.SentencePiece
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("the normaliser must only escape white space and put one in front")
    pieces, byte_ids, outputs = {}, [0] * 256, []
    # digits such as a raised two count as signs: pieces join them with those
    signs = "".join(sorted({c for p in model.pieces if p.type == kind.NORMAL for c in p.piece if not c.isalpha()}))
    chunk = _chunk_pattern(signs)
    for i, p in enumerate(model.pieces):
        if p.type == kind.NORMAL:
            if re.match(chunk, p.piece).end() != len(p.piece):
                raise ValueError("a piece crosses the border of two chunks")
            pieces[p.piece] = (p.score, i)
            outputs.append(p.piece.replace(META, " ").encode())
        elif p.type == kind.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            outputs.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type in (kind.CONTROL, kind.UNKNOWN):
            outputs.append(b"" if p.type == kind.CONTROL else model.trainer_spec.unk_surface.encode())
        else:
            raise ValueError("user-defined and unused pieces are not supported")
    return {"pieces": pieces, "byte_ids": byte_ids, "outputs": outputs, "chunk": chunk}


class Transducer:
    def __init__(self, compiled: dict):
        self.pieces, self.byte_ids, self.outputs = compiled["pieces"], compiled["byte_ids"], compiled["outputs"]
        self.longest = max(map(len, self.pieces))
        self.arcs: dict = {}  # the pieces as a tree of letters; "" leads to the piece that ends there
        for p in self.pieces:
            node = self.arcs
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.left, self.right = {}, {}  # edges of a piece's merge tree: [(part, rank), ...] from the piece inwards
        self.odd = set()  # pieces whose merges do not rise in rank: pairs with them are merged outright
        self.packed = {p: pack("<i", i) for p, (_, i) in self.pieces.items()}
        self.chunks = Memo(self._compose, limit=500_000)
        self.pairs = Memo(self._crosses, limit=100_000, longest=2)
        self.chunk = re.compile(compiled["chunk"])

    def merged(self, text: str) -> list[str]:
        """A short text's letters merged by score, the leftmost of equal ones first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                hit = self.pieces.get(parts[i] + parts[i + 1])
                if hit and (best is None or hit[0] > best):
                    best, at = hit[0], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, piece: str) -> bool:
        """Work out a piece's edges; whether its own letters merge to it."""
        made, parts, ranks = {}, list(piece), []
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                hit = self.pieces.get(parts[i] + parts[i + 1])
                if hit and (best is None or hit[0] > best):
                    best, at = hit[0], i
            if best is None:
                break
            made[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            ranks.append(-best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        ok = parts == [piece]
        if ok:
            rank = lambda x: -self.pieces[x][0] if x in made else float("-inf")
            for side, edges in ((0, self.left), (1, self.right)):
                x, out = piece, [(piece, rank(piece))]
                while x in made:
                    x = made[x][side]
                    out.append((x, rank(x)))
                edges[piece] = out
            if ranks != sorted(ranks) or META in piece[1:]:  # runs of the meta symbol share one score
                self.odd.add(piece)
        else:
            self.left[piece] = self.right[piece] = None
        return ok

    def _whole(self, piece: str) -> bool:
        if piece not in self.left:
            self._edges(piece)
        return self.left[piece] is not None

    def _crosses(self, pair: tuple[str, str]) -> bool:
        """Whether some merge crosses the border of two neighbours. A letter outside the model merges with nothing."""
        a, b = pair
        if a not in self.pieces or b not in self.pieces:
            return False
        if a in self.odd or b in self.odd:
            return self.merged(a + b) != [a, b]
        xs, ys, pieces = self.right[a], self.left[b], self.pieces
        i = j = 0
        gone_x = gone_y = float("inf")  # ranks at which the two parts are used up
        while True:
            (x, rx), (y, ry) = xs[i], ys[j]
            hit = pieces.get(x + y)
            if hit and -hit[0] < gone_x and -hit[0] <= gone_y:  # of equal ones the leftmost goes first
                return True
            if rx >= ry:  # x came later: before that, its own right part stood there
                if i + 1 == len(xs):
                    return False
                i, gone_x = i + 1, rx
            else:
                j, gone_y = j + 1, ry

    def _arcs_from(self, text: str, at: int) -> list[str]:
        """Pieces that start here, the longest last; where the letter is none, its byte fallback."""
        node, whole, out = self.arcs, self.left, [] if text[at] in self.pieces else [text[at]]
        for c in text[at:at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            piece = node.get("")
            if piece is None:
                continue
            if (whole[piece] if piece in whole else self._whole(piece)):
                out.append(piece)
        return out

    def _compose(self, text: str) -> bytes:
        n, at, path, dead, crosses = len(text), 0, [], set(), self.pairs
        left = [self._arcs_from(text, 0)]  # arcs not yet tried, of each place on the path
        while at < n:
            if not left[-1]:
                dead.add(at)
                left.pop()
                at -= len(path.pop())
                continue
            piece = left[-1].pop()
            end = at + len(piece)
            if end not in dead and not (path and crosses[path[-1], piece]):  # else it weighs infinity
                path.append(piece)
                at = end
                if at < n:
                    left.append(self._arcs_from(text, at))
        get = self.packed.get
        return b"".join([get(p) or pack(f"<{len(p.encode())}i", *[self.byte_ids[b] for b in p.encode()]) for p in path])

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(META + text.replace(" ", META))))

    def decode(self, ids) -> str:
        return decode_ids(self.outputs, ids)


def decode_ids(outputs: list[bytes], ids) -> str:
    out = b"".join(map(outputs.__getitem__, ids)).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def _transducer(key: str, compiled: dict) -> Transducer:
    if key not in _WORKER:
        _WORKER[key] = Transducer(compiled)
    return _WORKER[key]


def _bounded(batches, at: int, limit: int = 2 << 20):
    """The batches in runs of whole rows with about ``limit`` bytes of text in column ``at``."""
    for b in batches:
        block = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield b.slice(x, y - x)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded_col: str | None = None) -> DataFrame:
    """``id``, ``text`` and ``ids`` (array of int) of every document; with ``decoded_col``, also the text behind
    the ids, decoded in the same pass."""
    spark = docs.sparkSession
    python_ready(spark)
    known = spark.sparkContext.broadcast(compile_model(model_path))
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    extra = [decoded_col] if decoded_col else []

    def work(batches):
        fst = _transducer(model_path, known.value)
        for b in _bounded(batches, 1):
            packed = [fst.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            out = [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))]
            if extra:
                out.append(pa.array([fst.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "text", "ids", *extra])

    schema = f"id {base.schema['id'].dataType.simpleString()}, text string, ids array<int>"
    return base.mapInArrow(work, schema + "".join(f", `{c}` string" for c in extra))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input with the text behind its ids."""
    spark = encoded.sparkSession
    python_ready(spark)
    known = spark.sparkContext.broadcast(compile_model(model_path)["outputs"])
    at = encoded.columns.index(ids_col)

    def work(batches):
        outputs = known.value
        for b in batches:
            lists = b.column(at)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            first = ends[0]  # one document's ids at a time as Python numbers
            text = [decode_ids(outputs, flat[x - first:y - first].tolist()) for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(work, f"{schema}, `{out_col}` string")
