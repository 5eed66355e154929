"""Ids stay those of the library while the encoder's memory fills, turns and forgets."""

import random

import numpy as np
from tokenizers import Tokenizer

from changelens.llm import tokenizing


def test_generations(monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMO", 40)
    monkeypatch.setattr(tokenizing, "CALL", 7)
    some, library = random.Random(5), Tokenizer.from_file(tokenizing.default_file())
    words = ["the", "Thing", "naïve", "über", "x1", "42", "don't", "we'll", "--", "…", "日本", "a,b", "©", "ÿÿ", "e" * 90, "\t", "\r", "\n\n", "  ", ""]
    encoder = tokenizing.Encoder(tokenizing.default_file())
    for turn in range(30):
        texts = [some.choice((" ", "", "\n")).join(some.choice(words) + some.choice(("", "", chr(97 + turn % 26) * some.randint(1, 9))) for _ in range(some.randint(0, 40))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    # The present generation, the one before it and the pre-tokens of one batch.
    assert len(encoder.memo.old) + len(encoder.memo) < 40 + 2 * 5 * 80 and len(encoder.starts) == encoder.memo.known
