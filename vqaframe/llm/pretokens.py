"""Pre-tokens of byte-level tokenizers, found with ``re`` and checked against the library.

A tokenizer file's own splitter runs its pattern over Unicode classes (letter, number, blank, other).
The pattern below runs the same alternatives over Python's classes. The two agree for nearly all
characters; which ones is not assumed but proved: the first time a character is met, its class is read
off the library's splitter and compared. A text with a character that differs is split by the library.
"""

from __future__ import annotations

import re
import unicodedata

from tokenizers import Tokenizer

#: The classes in Python's terms.
_LETTER, _NUMBER, _BLANK = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"\s")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else the next free code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


_ALPHABET = byte_alphabet()
_TO_BYTE = {c: b for b, c in enumerate(_ALPHABET)}
_LATIN = {b: c for b, c in enumerate(_ALPHABET)}
_SPACE = _ALPHABET[32]


def to_symbols(piece: str) -> str:
    if piece.isascii() and piece.isprintable():  # of these only the space has a stand-in
        return piece.replace(" ", _SPACE)
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LATIN)


def from_symbols(symbols: str) -> str | None:
    """The text behind byte symbols, or None if they aren't whole characters."""
    try:
        return bytes(_TO_BYTE[c] for c in symbols).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


class Splitter:
    """Base: which characters the pattern and the library class alike."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special_ids = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.alike: dict[str, bool] = {}

    def _own_class(self, c: str) -> str:
        return ("L" if _LETTER.match(c) else "N" if _NUMBER.match(c) else "S" if _BLANK.match(c) else "O")

    def _library_class(self, c: str) -> str:
        raise NotImplementedError

    def proved(self, text: str) -> bool:
        """Every character of the text is classed alike."""
        alike = self.alike
        for c in set(text):
            ok = alike.get(c)
            if ok is None:
                ok = alike[c] = self._own_class(c) == self._library_class(c)
            if not ok:
                return False
        return True

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        if self.at_special is None or "<" not in text:
            return [text]
        return self.at_special.split(text)


class WordSplitter(Splitter):
    """For a lower-casing tokenizer that drops white space (normaliser: NFC, blanks to a space, lower case)."""

    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, tok: Tokenizer):
        super().__init__(tok)
        self.plain: dict[str, bool] = {}

    def _library_class(self, c: str) -> str:
        pre = self.tok.pre_tokenizer.pre_tokenize_str
        if len(pre("a" + c + "a")) == 1:
            return "L"
        if not pre(c):
            return "S"
        return "N" if len(pre(c + c)) == 2 else "O"

    def _normalised(self, text: str) -> str | None:
        """The text lower-cased if each character's normal form is proved to be that, else None."""
        if text.isascii():
            return text.lower()
        plain = self.plain
        for c in set(text):
            ok = plain.get(c)
            if ok is None:
                want = " " if c.isspace() else c.lower()
                ok = plain[c] = (unicodedata.category(c) not in ("Cn", "Cs") and c != "Σ"
                                 and self.tok.normalizer.normalize_str(c) == want)
            if not ok:
                return None
        return text.lower() if unicodedata.is_normalized("NFC", text) else None

    def split(self, text: str) -> list[str]:
        low = self._normalised(text)
        if low is None:
            low = self.tok.normalizer.normalize_str(text)
        if self.proved(low):
            return self.pattern.findall(low)
        return [low[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(low)]


class SpaceSplitter(Splitter):
    """For a case-keeping tokenizer whose pre-tokens carry their leading space."""

    # words of A-Z and a-z only come first: the same pre-tokens as by the letters' own form, found faster
    pattern = re.compile(r" ?[A-Za-z]++(?![^\W\d_])|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

    def _library_class(self, c: str) -> str:
        pre = self.tok.pre_tokenizer.pre_tokenize_str
        if len(pre("a" + c + "a")) == 1:
            return "L"
        if len(pre("1" + c + "1")) == 1:
            return "N"
        if len(pre("!" + c + "!")) == 1:
            return "O"
        return "S"

    def split(self, text: str) -> list[str]:
        if self.proved(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]


class Memo(dict):
    """Results by short string, in two generations of at most ``limit`` each; what leaves is worked out again."""

    def __init__(self, work, known=None, limit: int = 250_000, longest: int = 48):
        super().__init__()
        self.work, self.known, self.old, self.limit, self.longest = work, known or {}, {}, limit, longest

    def __missing__(self, piece):
        out = self.known.get(piece)
        if out is None:
            out = self.old.get(piece)
        if out is None:
            out = self.work(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out
