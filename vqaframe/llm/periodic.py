"""Periodic run detection: stretches of words that repeat with a period, found in full and collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of
at least max(``min_length``, 2 * q) which no neighbouring word extends with that period.

Method: scale-tiled distribution. Periods come in octaves (2^k to 2^(k+1) - 1). For each octave a document is
exploded into tiles of 16 * 2^k words which overlap by 4 * 2^k, more than any shortest run of the octave, so every
run lies in a tile or is covered by pieces that overlap by more than its period; the octaves up to ``base_octave``
share the tiles of that one. Each tile is solved by itself: from every boundary (each 2^k words) the Z-function of
the words to its right, and that of the words to its left read backwards, say for each period how far the text
goes on repeating; both together are a run's piece. Pieces are shuffled by document and period, where intervals that
overlap by a period or more are stitched into one run.

The Z-functions of all boundaries of a batch of tiles are taken at once, over hashes of 1, 2, 4, ... words: as one
side of a boundary holds half of what a run must have beyond its period, one comparison of hashes settles nearly
all periods, and the rest gallop. Every piece is then compared word by word; should a hash ever lie, the batch
is solved again with exact numbers in place of hashes. A piece whose period is a multiple of a shorter one is that
one's and is left out.

Tiles are solved in the task that cuts them, since dealing them out costs a shuffle of the corpus; those of texts
above ``spread_bytes`` (which can have several tiles) are dealt to all tasks. A task's memory grows with its longest
tile, at most one document. Pieces and runs are small; the texts are shuffled once, to join them.

Defined results: a null or empty text has no words and no runs; repeated rows (equal id and text) have the same
runs each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vqaframe.llm.common import materialise, python_ready

_BATCH_WORDS = 1 << 17  # words solved at a time, or one tile
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tiles_of(n: int, min_length: int, base_octave: int) -> list[tuple[int, int, int, int]]:
    """(first octave, last octave, first word, end) of the tiles of a document of n words."""
    out, lowest = [], 0
    octave = base_octave
    while n >= max(min_length, 2 << lowest):
        overlap = max(4 << octave, 2 * min_length)
        size = 4 * overlap
        at = 0
        while True:
            out.append((lowest, octave, at, min(n, at + size)))
            if at + size >= n:
                break
            at += size - overlap
        lowest = octave = octave + 1
    return out


class Levels:
    """Hashes of all stretches of 2^j words, made when asked for. ``exact``: numbers that are equal only for equal stretches."""

    def __init__(self, words: np.ndarray, exact: bool = False):
        self.exact = exact
        self.made = [words.astype(np.uint64) if exact else self._mix(words.astype(np.uint64), np.uint64(1))]

    @staticmethod
    def _mix(a, b):
        with np.errstate(over="ignore"):
            x = (a * _M1 + b) * _M2
            x ^= x >> np.uint64(29)
            x *= _M1
        return x ^ (x >> np.uint64(32))

    def __getitem__(self, j: int) -> np.ndarray:
        while len(self.made) <= j:
            last, step = self.made[-1], 1 << (len(self.made) - 1)
            a, b = last[:max(0, len(last) - step)], last[step:]
            if self.exact:
                self.made.append(np.unique(a * np.uint64(1 << 32) + b, return_inverse=True)[1].astype(np.uint64))
            else:
                self.made.append(self._mix(a, b))
        return self.made[j]


def _same(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return level[a] == level[b]


def z_values(levels: Levels, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words from a and b on (or, with ``back``, before them) are equal, at most ``limit``."""
    got = np.zeros(len(a), np.int64)

    def step(j, which):
        size = 1 << j
        which = which[got[which] + size <= limit[which]]
        shift = -got[which] - size if back else got[which]
        which = which[_same(levels[j], a[which] + shift, b[which] + shift)] if len(which) else which
        got[which] += size
        return which

    alive, j = np.arange(len(a)), 0
    while len(alive):
        alive = step(j, alive)
        j += 1
    for j in range(j - 2, -1, -1):
        step(j, np.arange(len(a)))
    return got


def _prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def _primitive(levels: Levels, octave: int, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no shorter period of a piece divides its own."""
    ok = np.ones(len(start), bool)
    by_prime = defaultdict(list)
    for q in np.unique(period).tolist():
        for r in _prime_factors(q):
            by_prime[r].append(q)
    for r, qs in by_prime.items():
        at = np.flatnonzero(np.isin(period, qs) & ok)
        s, q = start[at], period[at]
        tail = q - (1 << octave)
        level = levels[octave]
        ok[at[_same(level, s, s + q // r) & _same(level, s + tail, s + tail + q // r)]] = False
    return ok


def _octave_pieces(levels: Levels, octave: int, lo: np.ndarray, hi: np.ndarray, min_length: int):
    """(start, end, period) of all pieces with a period of the octave. lo, hi: bounds of the tile of each word."""
    step = 1 << octave
    periods = np.arange(step, 2 * step) if octave < 5 else np.array([step])
    beyond = int(np.maximum(min_length - periods, periods).min())  # words that a run has beyond its period, at least
    j = max(0, -(-beyond // 2)).bit_length() - 1
    h, level = 1 << j, levels[j]
    b = np.flatnonzero(hi - lo >= max(min_length, 2 * step))  # the word a period after the boundary
    away = b - lo[b]
    b, away = b[away >= step], away[away >= step]
    period = step + (away & (step - 1))
    a = b - period  # the boundary
    right = np.zeros(len(a), bool)
    inside = np.flatnonzero(b + h <= hi[b])
    right[inside] = _same(level, a[inside], b[inside])
    inside = np.flatnonzero((a - h >= lo[a]) & ~right)
    right[inside] |= _same(level, a[inside] - h, b[inside] - h)
    a, b, period = a[right], b[right], period[right]
    start = a - z_values(levels, a, b, a - lo[a], True)
    end = b + z_values(levels, a, b, hi[b] - b, False)
    keep = end - start >= np.maximum(min_length, 2 * period)
    found = np.stack([start[keep], end[keep], period[keep]])
    found = found[:, np.lexsort(found)]
    if found.shape[1]:
        found = found[:, np.r_[True, (found[:, 1:] != found[:, :-1]).any(axis=0)]]
        found = found[:, _primitive(levels, octave, found[0], found[2])]
    return found


def _repeats(words: np.ndarray, found: np.ndarray) -> bool:
    """Whether every piece has its period, word by word."""
    size = found[1] - found[0] - found[2]
    for part in np.array_split(np.arange(len(size)), max(1, int(size.sum()) >> 22)):
        n = size[part]
        at = np.arange(int(n.sum())) + np.repeat(found[0][part] - np.cumsum(n) + n, n)
        if (words[at] != words[at + np.repeat(found[2][part], n)]).any():
            return False
    return True


def solve_tiles(tiles: list[np.ndarray], octaves: list[tuple[int, int]], min_length: int):
    """(tile number, start in the tile, end, period) of the pieces in each tile."""
    sizes = np.array([len(t) for t in tiles])
    ends = np.cumsum(sizes)
    words = np.concatenate(tiles)
    which = np.repeat(np.arange(len(tiles)), sizes)
    first, last = np.array(octaves).T
    for exact in (False, True):
        levels, parts = Levels(words, exact), []
        for octave in range(int(first.min()), int(last.max()) + 1):
            asked = (first <= octave) & (octave <= last)
            hi = np.where(asked, ends, ends - sizes)[which]  # a tile that isn't asked is empty
            if (np.where(asked, sizes, 0) >= max(min_length, 2 << octave)).any():
                parts.append(_octave_pieces(levels, octave, (ends - sizes)[which], hi, min_length))
        found = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        if exact or _repeats(words, found):
            break
    tile = which[found[0]]
    base = (ends - sizes)[tile]
    return tile, found[0] - base, found[1] - base, found[2]


def _tiles(text: bytes, min_length: int, base_octave: int):
    """(first octave, last octave, first word, words as numbers of the document) of each tile of a text."""
    number = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, text.split()), np.int32)  # bytes: the blanks of ASCII
    for low, high, at, end in tiles_of(len(words), min_length, base_octave):
        yield low, high, at, words[at:end]


def _in_batches(tiles):
    """Lists of (row, first octave, last octave, first word, words) of about ``_BATCH_WORDS`` words."""
    held, size = [], 0
    for tile in tiles:
        if held and size + len(tile[4]) > _BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(tile)
        size += len(tile[4])
    if held:
        yield held


def _pieces(b: pa.RecordBatch, tiles, min_length: int):
    """Batches of pieces (id, version, period, start, end) of tiles of the rows of ``b``, whose first columns are id and version."""
    for held in _in_batches(tiles):
        tile, start, end, period = solve_tiles([x[4] for x in held], [x[1:3] for x in held], min_length)
        if len(tile):
            pick = pa.array(np.array([x[0] for x in held])[tile])
            at = np.array([x[3] for x in held])[tile]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), *[pa.array(x, pa.int64()) for x in (period, start + at, end + at)]],
                ["id", "version", "period", "start", "end"])


def _solved_in_place(base: DataFrame, min_length: int, base_octave: int) -> DataFrame:
    """One row per piece of the texts (id, version, text): tiles are solved by the task that cuts them."""

    def work(batches):
        for b in batches:
            tiles = ((r, *tile) for r, text in enumerate(b.column(2).to_pylist()) for tile in _tiles(text, min_length, base_octave))
            yield from _pieces(b, tiles, min_length)

    return base.mapInArrow(work, _piece_schema(base))


def _solved_anywhere(base: DataFrame, min_length: int, base_octave: int) -> DataFrame:
    """The same, with the tiles dealt to all tasks."""

    def cut(batches):
        for b in batches:
            tiles = ((r, *tile) for r, text in enumerate(b.column(2).to_pylist()) for tile in _tiles(text, min_length, base_octave))
            for held in _in_batches(tiles):
                row, low, high, at, words = zip(*held, strict=True)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                     pa.array(at, pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())],
                    ["id", "version", "low", "high", "at", "words"])

    def solve(batches):
        for b in batches:
            words = (np.frombuffer(w.as_py(), np.int32) for w in b.column(5))
            tiles = zip(range(b.num_rows), *[b.column(c).to_pylist() for c in (2, 3, 4)], words)
            yield from _pieces(b, tiles, min_length)

    id_type = base.schema["id"].dataType.simpleString()
    tiles = base.mapInArrow(cut, f"id {id_type}, version bigint, low int, high int, at bigint, words binary")
    return tiles.repartition("id", "version", "low", "at").mapInArrow(solve, _piece_schema(base))


def _piece_schema(base: DataFrame) -> str:
    return f"id {base.schema['id'].dataType.simpleString()}, version bigint, period bigint, start bigint, end bigint"


def stitch(pieces: DataFrame) -> DataFrame:
    """One row per run (id, version, start, length, period): pieces of one period that overlap by it or more are one run."""
    by_period = Window.partitionBy("id", "version", "period").orderBy("start", "end")
    reached = F.max("end").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(reached - F.col("start") < F.col("period"), F.lit(True))
    return (pieces.distinct().withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(by_period))
            .groupBy("id", "version", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .select("id", "version", "start", (F.col("end") - F.col("start")).alias("length"), "period"))


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for a, z in sorted((x["start"] + x["period"], x["start"] + x["length"]) for x in runs):
        if a > at:
            out.extend(words[at:a])
        at = max(at, z)
    return out + words[at:]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12,
                  base_octave: int = 11, spread_bytes: int = 1 << 16) -> DataFrame:
    """One row per document: ``id``, ``runs`` (array of start, period, length by start, then period), ``collapsed``.

    ``collapsed``: the words that no run holds after its first period, joined by one blank.
    """
    python_ready(docs.sparkSession)
    text = F.coalesce(docs[f"`{text_col}`"].cast("binary"), F.lit("").cast("binary"))
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    long = F.octet_length("text") > spread_bytes
    pieces = _solved_in_place(base.filter(~long), min_length, base_octave).unionByName(
        _solved_anywhere(base.filter(long), min_length, base_octave))
    pieces = materialise(pieces, "periodic-pieces")
    runs = stitch(pieces).groupBy(F.col("id").alias("r_id"), F.col("version").alias("r_version")).agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one document
    runs = materialise(runs, "periodic-runs")
    # runs grow with the corpus, so the join is a shuffle at every size
    joined = base.join(runs.hint("merge"), base["id"].eqNullSafe(runs["r_id"]) & (base["version"] == runs["r_version"]), "left")
    joined = joined.select("id", "text", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)).alias("runs"))
    id_type, run_type = (joined.schema[c].dataType.simpleString() for c in ("id", "runs"))

    def collapse(batches):
        for b in batches:
            out = [b" ".join(kept_words(t.split(), r)) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary()).view(pa.string())],
                                             ["id", "runs", "collapsed"])

    return joined.mapInArrow(collapse, f"id {id_type}, runs {run_type}, collapsed string")
