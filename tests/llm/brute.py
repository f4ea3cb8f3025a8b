"""Plain Python versions of the operators, and a small table of edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, row int, kept boolean, "
          "n_words string, component_id double")


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def edge_texts():
    body = " ".join(f"word{i} and thing{i * 7 % 13} of Ünïcode" for i in range(120))
    near = body.replace("word50", "WORD50x")
    return [None, "", " \n\t ", "a", "one two three", body, body, near, body + "\n" + body, body[:900] + "\nshared line that is long enough",
            "tail\nShared line that is LONG enough\n" + near[200:], "shared line that is long enough  \nx",
            "Σίσυφος ΟΔΟΣ İstanbul don't we'll I'm 1²½ Ⅷ é \x1c\x1d\x85​　 ab_c __   🙂🙂 नमस्ते 漢字かな<|endoftext|>x<|startoftext|>",
            "<|endoftext|>", "\x00\x01 nul", "spaces    many   \n\n\n  ▁ meta", ("xyz" * 40 + " ") * 300, "a" * 3000, "lorem " * 2500,
            "ab" * 700, "Released under the MIT License.\nfoo", "ﬁ ℌ ㎏ Å ̈́ ǅ ß ẞ"]


def edge_rows():
    rows = [(k, t, None if k == 3 else "en", "src" if k % 3 else None, len(t or ""), "x", k, None, "z", 1.5)
            for k, t in enumerate(edge_texts())]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no id " * 30, "en", "src", 180, None, 0, None, None, None))
    return rows


def line_dedup(docs, min_chars=20, min_docs=3):
    """[(id, n_lines, n_dropped, kept text)] of (id, text) rows."""
    keys = [[lower_az(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in docs]
    held = defaultdict(list)
    for (i, _), ks in zip(docs, keys):
        for k in set(ks):
            if len(k) >= min_chars:
                held[k].append(i)
    owner = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for (i, t), ks in zip(docs, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks) if k not in owner or owner[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def base_stats(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def simhash(text):
    w = WORDS.findall(lower_az(text or ""))
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    c = [0] * 64
    for g in sh:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(sh))


def components(prints, max_bits=4):
    """Group number of each fingerprint in a list."""
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def passages(texts, length):
    """[(n_bytes, n_removed, n_spans, kept bytes)] of byte texts."""
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                cut[p:p + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if cut[i] and (i == 0 or not cut[i - 1]))
        out.append((len(t), sum(cut), spans, bytes(c for c, x in zip(t, cut) if not x)))
    return out


def passages_kept_once(texts, length):
    """[(n_removed, kept bytes)]: of equal strings the first by (text number, place) stays."""
    first = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p:p + length], (i, p))
    out = []
    for i, t in enumerate(texts):
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] != (i, p):
                cut[p:p + length] = b"\1" * length
        out.append((sum(cut), bytes(c for c, x in zip(t, cut) if not x)))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()
