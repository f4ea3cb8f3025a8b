"""Repeated passages: cut every byte covered by a string of ``length`` bytes that starts at two places.

With ``keep_first`` the first occurrence of each string (by id, text hash, place) doesn't count, so that of every
passage one copy stays.

Method: column-wise multi-document construction. The strings of a collection are aligned, and each round
inserts one symbol per string: the order of the strings by what they have read so far (the collection's
Burrows-Wheeler order) and the length each shares with its neighbour (common prefixes, here read towards
the round's column) are updated together from one sequential file of columns. A string whose shared length
reaches the wanted one has a repeated passage that ends in that column.

Run on whole documents, this takes as many rounds over all data as the longest document has bytes. The
work is therefore cut into short aligned strings that can hold all answers:

1. Anchors. Of the grams (``gram`` bytes) in a window of ``length`` bytes, the one with the least hash is
   the window's anchor. Equal windows have equal anchors at equal places, so windows are compared only
   around anchors of equal hash. Consecutive windows share an anchor: one row for about 137 bytes.
2. A gram found at one place only has no repeated window. Windows around a gram whose contexts (all bytes
   of its windows) are all equal are all repeated. Only differing contexts go on, one of each.
3. Blocks. The windows around an anchor are taken 64 starts at a time, at fixed distances from the anchor.
   All windows of a block share its core; they differ in how much of the 63 bytes before and after it they
   take. Blocks with a core seen once are done: none of their windows is repeated.
4. Construction. The 126 edge bytes of all blocks with equal cores are the collection: one column, one
   symbol per string, each round. A shared length of 63 in column c says that window c - 62 is repeated; strings
   that share it stand together, and the first of them by owner is the window's first occurrence.
   Groups go to tasks by their core. A core with more than ``most`` different edges does not enter a task:
   its windows are counted by hash over all tasks, with the same result.

Passages by words. With ``words``, passages of more than that many words (``[^\x20\x09-\x0D]+``, whatever white space
stands between) that stand at another place too are found as well, however few bytes they have: steps 1 and 2 with words
for bytes, then the windows of the differing contexts are counted by hash, as there are few. The texts move with step 3's.

Counts combine before shuffles; joins shuffle both sides, so Spark splits hot keys. Contexts and cores are
compared by 128-bit hashes, edges byte by byte.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` stay whole; repeated
rows are copies of each other (with ``keep_first``, rows of equal id and text are one place and fare alike);
matches never cross documents; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import BLANK, materialise, packed, python_ready

BLOCK = 64  # windows per block; their marks fit one long
EDGE = BLOCK - 1
_PIECE = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict = {}
_SPACE = np.isin(np.arange(256), list(BLANK.encode()))
_WORD_GRAM = 8  # words of an anchor's gram


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if _POWERS.get("n", 0) < n:
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
            _POWERS["down"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)])
        _POWERS["n"] = n
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at each place of a byte array; depends on the gram's bytes only."""
    return _spans_hashed(t, slice(0, len(t) - gram + 1), slice(gram, len(t) + 1))


def _spans_hashed(t: np.ndarray, starts, ends) -> np.ndarray:
    """64-bit hash of each of the given ranges of a byte array; depends on the range's bytes only."""
    n = len(t)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def window_anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive hashes (the first of equal ones)."""
    n = len(h)
    bits = np.uint64(int(w).bit_length())
    blocks = -(-n // w)
    key = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = h >> bits << bits
    key = key.reshape(blocks, w)
    key |= np.arange(w, dtype=np.uint64)
    key.reshape(-1)[n:] = np.iinfo(np.uint64).max
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(key, axis=1).reshape(-1)
    p = np.arange(n - w + 1)
    a, b = after[:n - w + 1], before[w - 1:n]
    first = (a >> bits) <= (b >> bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    return np.where(first, p // w * w + (a & mask).astype(np.int64), (p + w - 1) // w * w + (b & mask).astype(np.int64))


def _runs(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, length: int):
    """(text number, anchor, first window, last window, gram hash) of texts lying one after the other in t."""
    if len(t) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return _by_anchor(gram_hashes(t, gram), starts, ends, gram, length)


def _by_anchor(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, length: int):
    """The same from the gram hashes, of bytes or of words."""
    at = window_anchors(h, length - gram + 1)
    count = np.maximum(0, ends - starts - length + 1)
    which = np.repeat(np.arange(len(starts)), count)
    p = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    at = at[p]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (which[1:] != which[:-1])]) if len(p) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(p) - 1] if len(p) else new
    return which[new], at[new], p[new], p[last], h[at[new]]


def text_anchors(texts: list[bytes], gram: int, length: int):
    """(text number, anchor, first window, last window, gram hash) over many texts, in bounded pieces."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > _PIECE:
            yield from _long_text(k, t, gram, length)
            continue
        if size + len(t) > _PIECE:
            yield _joined(texts, group, gram, length)
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        yield _joined(texts, group, gram, length)


def _joined(texts, group, gram, length):
    sizes = np.array([len(texts[k]) for k in group])
    ends = np.cumsum(sizes)
    t = np.frombuffer(b"".join(texts[k] for k in group), np.uint8)
    which, a, s, e, h = _runs(t, ends - sizes, ends, gram, length)
    base = (ends - sizes)[which]
    return np.array(group)[which], a - base, s - base, e - base, h


def _long_text(k: int, text: bytes, gram: int, length: int):
    """One text in pieces of windows; a run that goes on in the next piece stays one run."""
    held = None
    for c in range(0, len(text) - length + 1, _PIECE):
        t = np.frombuffer(text, np.uint8)[c:c + _PIECE + length - 1]
        _, a, s, e, h = _runs(t, np.array([0]), np.array([len(t)]), gram, length)
        a, s, e = a + c, s + c, e + c
        if held is not None:
            if held[0][0] == a[0]:
                s[0] = held[1][0]
            else:
                yield np.array([k]), *held
        if len(a) > 1:
            yield np.full(len(a) - 1, k), a[:-1], s[:-1], e[:-1], h[:-1]
        held = (a[-1:], s[-1:], e[-1:], h[-1:])
    if held is not None:
        yield np.array([k]), *held


class Words:
    """Words of a text: ``starts`` and ``ends`` in it, and ``at`` and ``to`` in ``joined``, where one blank stands between."""

    def __init__(self, t: np.ndarray):
        space = _SPACE[t]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        keep = ~space
        keep[self.ends[self.ends < len(t)]] = True
        self.joined = np.where(space, np.uint8(32), t)[keep]
        size = self.ends - self.starts
        self.to = np.cumsum(size + 1) - 1
        self.at = self.to - size


def passage_anchors(texts: list[bytes], length: int):
    """(text number, anchor, first window, last window, gram hash, context hash) in words, over many texts, in bounded pieces.

    A run that goes on in a long text's next piece comes as two rows: their contexts differ, so their windows are counted.
    """
    gram = min(length, max(_WORD_GRAM, length - 63))  # a run's windows fit the bits of a long
    group, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < 2 * length - 1:
            continue
        if len(t) > _PIECE:
            places, step = Words(np.frombuffer(t, np.uint8)), _PIECE // 8
            for w in range(0, len(places.starts) - length + 1, step):
                lo, hi = places.starts[w], places.ends[min(w + step + length - 1, len(places.ends)) - 1]
                _, a, s, e, *h = _passage_runs([t[lo:hi]], length, gram)
                yield np.full(len(a), k), a + w, s + w, e + w, *h
            continue
        if size + len(t) > _PIECE:
            which, *found = _passage_runs([texts[i] for i in group], length, gram)
            yield np.array(group)[which], *found
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        which, *found = _passage_runs([texts[i] for i in group], length, gram)
        yield np.array(group)[which], *found


def _passage_runs(texts: list[bytes], length: int, gram: int):
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = Words(np.frombuffer(b" ".join(texts), np.uint8))
    n = len(words.starts)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    h = _spans_hashed(words.joined, words.at[:n - gram + 1], words.to[gram - 1:])
    last = np.searchsorted(words.starts, ends)
    first = np.r_[0, last[:-1]]
    which, a, s, e, h = _by_anchor(h, first, last, gram, length)
    view = memoryview(words.joined)
    context = [xxhash.xxh3_64_intdigest(view[x:y], seed=b << 20 | c) for x, y, b, c in zip(
        words.at[s].tolist(), words.to[e + length - 1].tolist(), (a - s).tolist(), (e - a).tolist(), strict=True)] if len(a) else []
    base = first[which]
    return which, a - base, s - base, e - base, h, np.array(context, np.uint64)


def column_matches(group: np.ndarray, left: list[bytes], right: list[bytes], keep_first: bool = False) -> np.ndarray:
    """For each block, the bits of its windows that another block of its group holds too.

    ``group``: group numbers, rising. ``left``, ``right``: up to EDGE bytes before and after the core.
    ``keep_first``: not the bits of a window in the first block that holds it.
    The columns are written to a file and read one after the other; each round inserts one symbol per
    string into the order and the shared lengths.
    """
    m = len(group)
    marks = np.zeros(m, np.uint64)
    table = np.full((m, 2 * EDGE), -1, np.int16)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a:
            table[i, EDGE - len(a):EDGE] = np.frombuffer(a, np.uint8)
        if b:
            table[i, EDGE:EDGE + len(b)] = np.frombuffer(b, np.uint8)
    with tempfile.TemporaryFile() as columns:
        np.ascontiguousarray(table.T).tofile(columns)
        del table
        columns.seek(0)
        order, shared = np.arange(m), np.zeros(m + 1, np.int64)  # shared with the string before; one more as a guard
        for c in range(2 * EDGE):
            symbol = np.fromfile(columns, np.int16, m)[order]
            key = group.astype(np.int64) * 512 + symbol + 1
            move = np.argsort(key, kind="stable")
            key, symbol = key[move], symbol[move]
            order = order[move]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0)) + 1
            now = np.zeros(m + 1, np.int64)
            if len(same):
                ranges = np.stack([move[same - 1] + 1, move[same] + 1], axis=1).reshape(-1)
                now[same] = 1 + np.minimum.reduceat(shared, ranges)[::2]
            shared = now
            if c >= EDGE - 1:
                hit = np.maximum(shared[:m], shared[1:]) >= EDGE
                if keep_first and hit.any():
                    heads = np.flatnonzero(shared[:m] < EDGE)
                    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.r_[heads, m]))
                    hit &= order != least
                marks[order[hit]] |= np.uint64(1) << np.uint64(c - EDGE + 1)
    return marks


def anchors(base: DataFrame, gram: int, length: int) -> DataFrame:
    """One row per anchor of a document: its place, its first and last window, gram hash and context hash."""
    id_type = base.schema["id"].dataType.simpleString()
    names = ["id", "version", "a", "s", "e", "gram", "c1", "c2"]

    def work(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for which, a, s, e, h in text_anchors(texts, gram, length):
                context = b"".join(xxhash.xxh3_128_digest(memoryview(texts[k])[x:z + length], seed=(y - x) << 20 | (z - y))
                                   for k, y, x, z in zip(which.tolist(), a.tolist(), s.tolist(), e.tolist(), strict=True))
                c = np.frombuffer(context, np.int64).reshape(-1, 2)
                pick = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), *[pa.array(x.astype(np.int32)) for x in (a, s, e)],
                     pa.array(h.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names)

    return base.mapInArrow(work, f"id {id_type}, version bigint, a int, s int, e int, gram bigint, c1 bigint, c2 bigint")


def found_passages(text: DataFrame, length: int) -> DataFrame:
    """Anchors of passages of ``length`` words whose gram stands at several places: id, version, a, s, e, c1 (gram), c2, mixed."""
    id_type = text.schema["id"].dataType.simpleString()
    names = ["id", "version", "a", "s", "e", "c1", "c2"]

    def work(batches):
        for b in batches:
            for which, a, s, e, h, c in passage_anchors(b.column(2).to_pylist(), length):
                pick = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), *[pa.array(x.astype(np.int32)) for x in (a, s, e)],
                     pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names)

    every = materialise(text.mapInArrow(work, f"id {id_type}, version bigint, a int, s int, e int, c1 bigint, c2 bigint"), "word-anchors")
    grams = every.groupBy("c1").agg(F.count(F.lit(1)).alias("n"), F.min("c2").alias("lo"), F.max("c2").alias("hi"))
    grams = materialise(grams.filter(F.col("n") >= 2).select("c1", (F.col("lo") != F.col("hi")).alias("mixed")), "word-grams")
    return materialise(every.join(grams, "c1"), "word-found")


def passage_lists(found: DataFrame, contexts: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document (g_id, g_version) the runs of repeated passages, ``passages``.

    Bit i of ``again`` and ``later`` stands for the window i words before the anchor: it is repeated, and not the first of its kind.
    """
    bits = F.expr("shiftleft(1L, a - w)")
    place = F.struct("id", "version", "w")
    first = materialise(windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                        .filter(F.col("n") >= 2).drop("n"), "word-windows")
    marks = windows.join(first, ["k1", "k2"]).groupBy("c1", "c2").agg(
        F.bit_or(bits).alias("again"), F.bit_or(F.when(place != F.col("first"), bits)).alias("later"))
    place, whole, none = F.struct("id", "version", "a"), F.lit(-1).cast("long"), F.lit(0).cast("long")
    verdict = contexts.select("c1", "c2", "n", place.alias("first")).join(marks, ["c1", "c2"], "left")
    verdict = materialise(verdict.filter((F.col("n") >= 2) | F.col("again").isNotNull()), "word-verdict")
    run = F.struct("a", "s", "e", F.when(F.col("n") >= 2, whole).otherwise(F.col("again")).alias("again"),
                   F.when(place != F.col("first"), whole).otherwise(F.coalesce("later", none)).alias("later")).alias("run")
    runs = found.join(verdict, ["c1", "c2"]).select(F.col("id").alias("g_id"), F.col("version").alias("g_version"), run)
    return materialise(runs.groupBy("g_id", "g_version").agg(F.collect_list("run").alias("passages")), "word-lists")


def blocks(base: DataFrame, picked: DataFrame, length: int, words: int = 0) -> DataFrame:
    """One row per block around a picked context: k1, k2 (core and distance), left, right, c1, c2, j, id, version, a.

    Picked contexts of passages (``of_words``) give one row per window: k1, k2 its hash, j its first word, left and right null.
    """

    def work(batches):
        for b in batches:
            out, row = [], []
            for r, (text, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                said = [x for x in found if x["of_words"]]
                if said:
                    yield passage_windows(b, r, text, *(np.array([x[c] for x in said]) for c in ("a", "s", "e", "c1", "c2")))
                for x in found:
                    a, s, e = x["a"], x["s"], x["e"]
                    if x["of_words"]:
                        continue
                    for j in range((a - e) // BLOCK, (a - s) // BLOCK + 1):
                        lo = a - (BLOCK * j + EDGE)
                        core = xxhash.xxh3_128_digest(memoryview(text)[lo + EDGE:lo + length], seed=j)
                        k1, k2 = struct.unpack("<qq", core)
                        out.append((k1, k2, text[max(0, lo):lo + EDGE], text[lo + length:lo + length + EDGE],
                                    x["c1"], x["c2"], j, a))
                        row.append(r)
                if len(out) > 50_000:
                    yield batch(b, row, out)
                    out, row = [], []
            if out:
                yield batch(b, row, out)

    def passage_windows(b, r, text, a, s, e, c1, c2):
        spoken = Words(np.frombuffer(text, np.uint8))
        view, count = memoryview(spoken.joined), e - s + 1
        w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(s, count)
        k = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(
            spoken.at[w].tolist(), spoken.to[w + words].tolist(), strict=True)), np.int64).reshape(-1, 2)
        pick = pa.array(np.full(len(w), r))
        no = pa.nulls(len(w), pa.binary())
        c1, c2, a = (np.repeat(x, count) for x in (c1, c2, a))
        return pa.RecordBatch.from_arrays(
            [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), no, no, pa.array(c1), pa.array(c2), pa.array(w.astype(np.int32)),
             pa.array(a.astype(np.int32)), b.column(0).take(pick), b.column(1).take(pick)], names)

    names = ["k1", "k2", "left", "right", "c1", "c2", "j", "a", "id", "version"]

    def batch(b, row, out):
        kinds = [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.int32()] * 2
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([*cols, b.column(0).take(pick), b.column(1).take(pick)], names)

    lists = materialise(picked.groupBy(F.col("id").alias("f_id"), F.col("version").alias("f_version")).agg(
        F.collect_list(F.struct("a", "s", "e", "c1", "c2", "of_words")).alias("found")), "passage-picked")  # of one document each
    joined = base.join(lists, base["id"].eqNullSafe(lists["f_id"]) & (base["version"] == lists["f_version"]))
    # repeated rows (same id and text) come more than once: they are copies of each other, as the counts then say
    id_type = base.schema["id"].dataType.simpleString()
    return joined.select("id", "version", "text", "found").mapInArrow(
        work, f"k1 bigint, k2 bigint, left binary, right binary, c1 bigint, c2 bigint, j int, a int, id {id_type}, version bigint")


def repeated_blocks(found: DataFrame, most: int, keep_first: bool = False) -> DataFrame:
    """(k1, k2, left, right, mark): the blocks with repeated windows, a bit for each.

    ``keep_first``: the marks of a block's first place (``owner``); all windows are repeated at its other places.
    """
    owner = [F.min(F.struct("id", "version", "a")).alias("owner")] if keep_first else []
    o = ["owner"] if keep_first else []
    kinds = materialise(found.groupBy("k1", "k2", "left", "right").agg(F.count(F.lit(1)).alias("n"), *owner), "passage-kinds")
    cores = materialise(kinds.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
                        .filter(F.col("total") >= 2).select("k1", "k2", "kinds"), "passage-cores")
    # written, so that a core with many edges is split in the join and its windows are dealt by their own hashes
    kinds = materialise(kinds.join(cores, ["k1", "k2"]), "passage-counted")
    small = kinds.filter(F.col("kinds").between(2, most))
    large = kinds.filter(F.col("kinds") > most)

    def work(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000:  # whole groups only: what may go on in the next batch is held back
                t = pa.Table.from_batches(held)
                key = t.column("k1").to_numpy(), t.column("k2").to_numpy()
                cut = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    def done(t):
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        group = np.cumsum(np.r_[False, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        marks = column_matches(group, t.column("left").to_pylist(), t.column("right").to_pylist(), keep_first)
        t = t.select(cols).append_column("mark", pa.array(marks.view(np.int64))).filter(pa.array(marks != 0)).combine_chunks()
        batch = t.to_batches()
        return batch[0] if batch else pa.RecordBatch.from_pylist([], schema=t.schema)

    cols = ["k1", "k2", "left", "right"]
    by_column = small.select(*cols, *o).repartition("k1", "k2").sortWithinPartitions("k1", "k2", *o).mapInArrow(
        work, "k1 bigint, k2 bigint, left binary, right binary, mark bigint")

    # too many for a task: each window by its own hash, counted over all tasks
    t = F.col("t")
    start = large.select(*cols, *o, F.explode(F.sequence(F.greatest(F.lit(0), EDGE - F.octet_length("left")),
                                                     F.octet_length("right"))).alias("t"))
    start = start.filter(t <= EDGE)
    own = F.expr(f"substring(left, octet_length(left) - ({EDGE} - t) + 1, {EDGE} - t)"), F.expr("substring(right, 1, t)")
    window = start.select(*cols, *o, "t", F.xxhash64(*own).alias("w1"), F.xxhash64(F.lit(1), *own).alias("w2"))
    keys = ["k1", "k2", "t", "w1", "w2"]
    first = [F.min("owner").alias("first")] if keep_first else []
    twice = window.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first).filter(F.col("n") > 1).drop("n")
    again = window.join(materialise(twice, "passage-windows"), keys)
    if keep_first:
        again = again.filter(F.col("owner") != F.col("first"))
    by_window = again.groupBy(*cols).agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("mark"))

    if keep_first:
        marks = by_column.unionByName(by_window).groupBy(*cols).agg(F.bit_or("mark").alias("mark"))
        own_marks = kinds.filter((F.col("n") >= 2) | (F.col("kinds") >= 2)).select(*cols, "owner").join(marks, cols, "left")
        return materialise(own_marks.withColumn("mark", F.coalesce("mark", F.lit(0).cast("long"))), "passage-marks")
    # equal blocks at several places: every window that exists is repeated
    copies = kinds.filter(F.col("n") >= 2).select(*cols, F.lit(-1).cast("long").alias("mark"))
    return materialise(by_column.unionByName(by_window).unionByName(copies).groupBy(*cols).agg(
        F.bit_or("mark").alias("mark")), "passage-marks")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 gram: int = 128, most: int = 1024, as_text: bool = False, keep_first: bool = False, words: int = 0) -> DataFrame:
    """One row per document: ``row`` (the input), ``id``, ``n_bytes``, ``n_removed``, ``spans`` (start, end), ``kept``.

    ``kept`` is the remaining bytes, or with ``as_text`` a string: characters of which a part was cut go.
    ``keep_first``: the first occurrence of every repeated string stays, unless another's copy covers it.
    ``words``: also ``passages`` (start, end in bytes), covered by more than ``words`` words that stand elsewhere too, and
    ``once``, the text without them but for the first of each; null if that is the whole text.
    """
    spark = docs.sparkSession
    python_ready(spark)
    raw = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    base = packed(docs, id=id_col, text=text_col).withColumn("text", raw(F.col("text"))).withColumn("version", F.xxhash64("text"))
    text = base.select("id", "version", "text")

    if words:
        spoken = found_passages(text, words + 1)
        said = materialise(spoken.groupBy("c1", "c2", "mixed").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "version", "a", "s", "e")).alias("r"))
            .select("c1", "c2", "mixed", "n", "r.*"), "word-contexts")

    all_anchors = materialise(anchors(text, gram, length), "passage-anchors")
    grams = materialise(
        all_anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("lo"), F.max("c1").alias("hi"))
        .filter(F.col("n") >= 2).select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "passage-grams")
    found = materialise(all_anchors.join(grams, "gram").drop("gram"), "passage-found")

    place = F.struct("id", "version", "a")
    contexts = materialise(
        found.filter("mixed").groupBy("c1", "c2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "version", "a", "s", "e")).alias("r"))
        .select("c1", "c2", "n", "r.*"), "passage-contexts")
    picked = contexts.withColumn("of_words", F.lit(False))
    if words:
        picked = picked.unionByName(said.filter("mixed").drop("mixed").withColumn("of_words", F.lit(True)))
    around = materialise(blocks(text, picked, length, words), "passage-blocks")
    if words:
        passages = passage_lists(spoken, said, around.filter("left is null").withColumnRenamed("j", "w"))
        around = around.filter("left is not null")
    marks = repeated_blocks(around, most, keep_first)
    keys = ["k1", "k2", "left", "right"]
    marked = around.join(marks, keys)
    if keep_first:
        marked = marked.withColumn("mark", F.when(place == F.col("owner"), F.col("mark")).otherwise(F.lit(-1)))
        marked = marked.filter(F.col("mark") != 0)
    marked = marked.groupBy("c1", "c2").agg(F.collect_list(F.struct("j", "mark")).alias("marks"))  # a handful of blocks each
    verdict = contexts.select("c1", "c2", (F.col("n") >= 2).alias("whole"), place.alias("first")).join(marked, ["c1", "c2"], "left")
    verdict = materialise(verdict.filter(F.col("whole") | F.col("marks").isNotNull()), "passage-verdict")

    here = F.struct("a", "s", "e", "whole", "marks").alias("x")
    marks_type = verdict.schema["marks"].dataType
    pure = found.filter(~F.col("mixed")).select("id", "version", "a", "s", "e", "c1", "c2", F.lit(True).alias("whole"),
                                                F.lit(None).cast(marks_type).alias("marks"))
    mixed = found.filter("mixed").join(verdict, ["c1", "c2"])
    if keep_first:
        firsts = materialise(pure.groupBy("c1", "c2").agg(F.min(place).alias("first")), "passage-firsts")
        pure = pure.join(firsts, ["c1", "c2"]).filter(place != F.col("first"))
        mixed = mixed.withColumn("whole", F.col("whole") & (place != F.col("first")))
        mixed = mixed.filter(F.col("whole") | F.col("marks").isNotNull())
    pure, mixed = (x.select("id", "version", "a", "s", "e", "whole", "marks") for x in (pure, mixed))
    lists = materialise(pure.unionByName(mixed).select(F.col("id").alias("f_id"), F.col("version").alias("f_version"), here)
                        .groupBy("f_id", "f_version").agg(F.collect_list("x").alias("found")), "passage-lists")
    # the text moves once, inside the row
    joined = base.drop("text").join(lists, base["id"].eqNullSafe(lists["f_id"]) & (base["version"] == lists["f_version"]), "left")
    joined = joined.withColumn("text", raw(F.col(f"row.`{text_col}`")))
    if words:
        joined = joined.join(passages, joined["id"].eqNullSafe(passages["g_id"]) & (joined["version"] == passages["g_version"]), "left")
    joined = joined.select("row", "id", "text", "found", *(["passages"] if words else []))
    row_type, id_type = (joined.schema[c].dataType.simpleString() for c in ("row", "id"))

    def cut(batches):
        for b in batches:
            removed, spans, kept, size = [], [], [], []
            for t, xs in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                ranges = covered(xs or [], length)
                parts, at = [], 0
                for x, y in ranges:
                    parts.append(t[at:x])
                    at = y
                parts.append(t[at:])
                kept.append(b"".join(parts))
                size.append(len(t))
                removed.append(len(t) - len(kept[-1]))
                spans.append([{"start": x, "end": y} for x, y in ranges])
            ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [b.column("row"), b.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(spans, ranges_type),
                       pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
            names = ["row", "id", "n_bytes", "n_removed", "spans", "kept"]
            if words:
                runs = [x.values for x in b.column("passages")]  # of the row's list, still Arrow
                cuts = [without_passages(t, *(x.field(c).to_numpy() for c in ("a", "s", "e", "again", "later")), words + 1)
                        if x is not None else ([], None) for t, x in zip(b.column("text").to_pylist(), runs, strict=True)]
                columns += [pa.array([[{"start": x, "end": y} for x, y in r] for r, _ in cuts], ranges_type),
                            pa.array([o for _, o in cuts], pa.string())]
                names += ["passages", "once"]
            yield pa.RecordBatch.from_arrays(columns, names)

    ranges = "array<struct<start: bigint, end: bigint>>"
    return joined.mapInArrow(cut, f"row {row_type}, id {id_type}, n_bytes bigint, n_removed bigint, "
                                  f"spans {ranges}, kept {'string' if as_text else 'binary'}"
                                  + (f", passages {ranges}, once string" if words else ""))


def without_passages(text: bytes, a, s, e, again, later, length: int) -> tuple[list[tuple[int, int]], str | None]:
    """Byte ranges of a document's passages of ``length`` words, and the text without those that are not the first (or None)."""
    words = Words(np.frombuffer(text, np.uint8))
    back = np.arange(int((a - s).max()) + 1)
    w = a[:, None] - back
    inside = (w >= s[:, None]) & (w <= e[:, None])

    def ranges(bits):
        starts = np.unique(w[inside & (bits[:, None] >> back & 1).astype(bool)])
        new = np.flatnonzero(np.diff(starts) > length) + 1
        if not len(starts):
            return []
        return list(zip(words.starts[starts[np.r_[0, new]]].tolist(),
                        words.ends[starts[np.r_[new - 1, len(starts) - 1]] + length - 1].tolist(), strict=True))

    out = ranges(later)
    parts, at = [], 0
    for x, y in out:
        parts.append(text[at:x])
        at = y
    return ranges(again), b"".join([*parts, text[at:]]).decode() if out else None


def covered(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Merged (start, end) byte ranges of a document's repeated windows."""
    starts = []
    for x in found:
        if x["whole"]:
            starts.append((x["s"], x["e"]))
            continue
        for m in x["marks"]:
            lo, bits = x["a"] - (BLOCK * m["j"] + EDGE), m["mark"] & (1 << BLOCK) - 1
            starts.extend((lo + t, lo + t) for t in range(BLOCK) if bits >> t & 1 and x["s"] <= lo + t <= x["e"])
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out
