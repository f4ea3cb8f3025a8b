import random
import re

import public_tokenizers
import sentencepiece

from vqaframe.llm import sentencepiece_fst

LETTERS = "abzAZ'stredé日ªǅ²1٣_-,  \n\t\x7f\xa0̈▁"


def test_chunks_and_pairs():
    path = public_tokenizers.path("piece_bpe_32k.model")
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.compile_model(path))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = re.compile(fst.chunk.pattern.split("])|", 1)[1])  # without the form for A-Z and a-z
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 30)))
        shown = "▁" + text.replace(" ", "▁")
        assert fst.chunk.findall(shown) == plain.findall(shown)
        assert fst.encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text))


def test_a_pair_of_pieces_is_judged_once():
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.compile_model(public_tokenizers.path("piece_bpe_32k.model")))
    made, work = [], fst.pairs.work
    fst.pairs.work = lambda pair: made.append(pair) or work(pair)
    rng = random.Random(7)
    for _ in range(2000):
        fst.encode("".join(rng.choice("thoneris") for _ in range(9)))
    assert made and len(made) == len(set(made))
