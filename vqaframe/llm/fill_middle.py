"""Fill-in-middle transformation: documents cut at unit borders and reordered around sentinels.

A unit is a run of ASCII letters or one other character. Two of a document's n + 1 unit borders, drawn by a
hash of its id, cut it into prefix, middle and suffix; the form says in which order the three are written.

Method: SWAR words. The UTF-8 bytes are viewed as 64-bit words. Letters and continuation bytes are marked in
the top bit of each byte by plain arithmetic on whole words; a byte ends a unit if the next one continues no
character and the two aren't both letters. ``bitwise_count`` gives the ends of each word and their running
sum the units before it, so the k-th border is found by a binary search for its word and a select inside
that word (byte-wise running counts by one multiplication, compared with k in one subtraction). No text is
turned into a list of units.

Documents are read in place, a batch at a time, and nothing is shuffled. Marks are made in blocks of
``_BLOCK`` words, so a very long text costs its own size twice and a constant besides.

Defined results: a null or empty text has no units and the form ``plain``, with itself (the empty text) as
output; a null id is hashed as the empty string; repeated rows give repeated rows, as ids are all that is
hashed; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import python_ready

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLOCK = 1 << 17
_ONES = 0x0101010101010101
_WORD = (1 << 64) - 1


def _each(byte: int) -> np.uint64:
    return np.uint64(byte * _ONES)


_TOP = _each(0x80)


def _letters(w: np.ndarray) -> np.ndarray:
    """Top bit of every byte that is an ASCII letter."""
    low = (w | _each(0x20)) & _each(0x7F)
    return (low + _each(0x80 - ord("a"))) & ~(low + _each(0x80 - ord("z") - 1)) & ~w & _TOP


def _continues(w: np.ndarray) -> np.ndarray:
    """Top bit of every byte 10xxxxxx."""
    return w & ~(w << np.uint64(1)) & _TOP


def unit_ends(text: bytes) -> np.ndarray:
    """One 64-bit word per 8 bytes, with the top bit of every byte that ends a unit."""
    size = -(-len(text) // 8)
    words = np.frombuffer(text + bytes(8 * size + 8 - len(text)), "<u8")  # one more word: what follows the last
    ends = np.empty(size, np.uint64)
    for a in range(0, size, _BLOCK):
        w = words[a:a + _BLOCK + 1]
        if len(w) > size - a:
            w = words[a:size + 1]
        letter, inside = _letters(w), _continues(w)
        following = [(m[:-1] >> np.uint64(8)) | (m[1:] << np.uint64(56)) for m in (letter, inside)]
        ends[a:a + len(w) - 1] = _TOP & ~following[1] & ~(letter[:-1] & following[0])
    if len(text) % 8:
        ends[-1] &= np.uint64((1 << 8 * (len(text) % 8)) - 1)
    return ends


class Units:
    """The unit borders of a text."""

    def __init__(self, text: bytes):
        self.ends = unit_ends(text)
        self.total = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)
        self.n = int(self.total[-1]) if len(self.total) else 0

    def border(self, k: int) -> int:
        """Bytes before the end of the k-th unit (k = 0: the start)."""
        if k == 0:
            return 0
        word = int(np.searchsorted(self.total, k))
        rest = k - (int(self.total[word - 1]) if word else 0)
        counts = (int(self.ends[word]) >> 7) * _ONES & _WORD  # byte i: ends among bytes 0 to i
        reached = ((counts | int(_TOP)) - rest * _ONES) & int(_TOP)
        return 8 * word + 8 - reached.bit_count() + 1


def _characters(part: bytes) -> int:
    return len(part.decode("utf-8", "replace"))


def rearrange(text: bytes, draws: tuple[int, int, int, int], marks: tuple[bytes, bytes, bytes], plain_from: int,
              spm_below: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    units = Units(text)
    n = units.n
    if not text or any(m in text for m in marks) or draws[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    first, last = sorted((units.border(draws[0] % (n + 1)), units.border(draws[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = marks
    if draws[3] % 100 < spm_below:
        form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, _characters(prefix), _characters(middle), out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1",
                   marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain_from: int = 90,
                   spm_below: int = 20) -> DataFrame:
    """One row per document: ``id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (string).

    ``marks``: the sentinels before prefix, suffix and middle. Of 100 draws those from ``plain_from`` on leave
    the text as it is, and of the rest those below ``spm_below`` put the suffix first.
    """
    python_ready(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    base = docs.select(docs[f"`{id_col}`"].alias("id"),
                       F.coalesce(docs[f"`{text_col}`"].cast("binary"), F.lit("").cast("binary")).alias("text"), *draws)
    id_type = base.schema["id"].dataType.simpleString()
    raw = tuple(m.encode() for m in marks)

    def work(batches):
        for b in batches:
            h = zip(*[b.column(2 + k).to_pylist() for k in range(4)], strict=True)
            done = [rearrange(t, d, raw, plain_from, spm_below) for t, d in zip(b.column(1).to_pylist(), h, strict=True)]
            n, form, before, between, out = zip(*done, strict=True) if done else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                 pa.array(between, pa.int64()), pa.array(out, pa.binary()).view(pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return base.mapInArrow(work, f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text again, from output and form (the sentinels occur once each unless the form is plain)."""
    p, s, m = (F.instr(output, x) for x in marks)
    wide = [len(x) for x in marks]
    end = F.char_length(output) + 1

    def between(a, b, skip):
        return F.substring(output, a + skip, b - a - skip)

    middle = between(m, end, wide[2])
    psm = F.concat(between(p, s, wide[0]), middle, between(s, m, wide[1]))
    spm = F.concat(between(p, m, wide[0]), middle, between(s, p, wide[1]))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
