"""Token ids and counts of random mixed texts against the libraries."""

import random

import numpy as np

from tracelens.llm import packing, tokencount

#: Characters that tokenizers treat apart: letters, digits, blanks of several kinds, marks, scripts, pictures, control characters.
KINDS = ("abcdefghij", "ABCXYZ", "0123456789", "   \t\n\r  ", "'\"!?.,-_#*</s>[]|", "éßñöçàÉ", "中文字的一", "かなカナ", "אבגדעברית", "кирилл", "😀👍🏽‍", "́̀‍﻿\x00\x7f", "▁Ġ")


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        some = r.sample(KINDS, r.randint(1, 5))
        yield "".join(r.choice(r.choice(some)) for _ in range(r.randint(0, 60)))


def test_ids_of_random_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    library, own = Tokenizer.from_file(path), packing.id_encoder(path)
    for t in texts(20_000, 1):
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_counts_of_random_texts():
    import sentencepiece

    path = tokencount.tokenizer_path()
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.counter(path)
    for t in texts(20_000, 2):
        assert own(t) == len(model.encode(t)), t
