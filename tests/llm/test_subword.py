"""Samples don't depend on how pieces are looked up, nor on which texts are drawn together."""

import numpy as np

from quern.llm import subword
from quern.llm.queries import tokenizer


def test_crowded_buckets_and_company(monkeypatch):
    texts, keys = ["", " ", "a  b", "the word of\nmany " * 9, "é😀\t▁x"], np.arange(5)
    plain = lambda got: [[(g[0].tolist(), *(round(x, 9) for x in g[1:])) for g in t] for t in got]
    want = plain(subword.sample_texts(subword.Vocabulary(tokenizer("piece_bpe_32k.model")), texts, keys, 3))
    monkeypatch.setattr(subword, "SIEVE_BITS", 6)
    v = subword.Vocabulary(tokenizer("piece_bpe_32k.model"))
    assert plain(subword.sample_texts(v, texts, keys, 3)) == want
    assert [plain(subword.sample_texts(v, [t], keys[i : i + 1], 3))[0] for i, t in enumerate(texts)] == want
