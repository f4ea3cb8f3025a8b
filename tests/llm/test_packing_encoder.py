import random
import re

import public_tokenizers
from tokenizers import Tokenizer

from vqaframe.llm import packing, pretokens

LETTERS = "abzAZ'stredé日ªǅ²1٣_-,  \n\t\x7f\x00\xa0̈"


def test_words_of_ascii_letters_are_found_as_before_and_remembered():
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
    rng = random.Random(5)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(tok)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        assert pretokens.SpaceSplitter.pattern.findall(text) == plain.findall(text)
        assert pretokens.from_symbols(pretokens.to_symbols(text)) == text
        ids = tok.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    made = []
    encoder.packed.work = lambda p: made.append(p) or b""
    words = [f"w{i}" for i in range(300_000)]
    for _ in range(3):  # invented words that come again are not merged again
        for w in words:
            encoder.packed[w]
    assert len(made) == len(words)
