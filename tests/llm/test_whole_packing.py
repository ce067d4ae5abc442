"""The ids are those of the tokenizer file."""

from __future__ import annotations

import numpy as np
import pytest

from stroma.llm import packing


def test_added_tokens_are_those_of_the_file():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    fresh, encode = Tokenizer.from_file(path), packing.Encoder(path)
    for t in ("x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|>b  c\n<|ENDOFTEXT|>", "<|endoftext|", "É<|startoftext|>é"):
        assert np.frombuffer(encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t
