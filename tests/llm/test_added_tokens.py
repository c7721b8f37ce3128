"""Texts with the strings of added tokens against a fresh tokenizer of the library."""

from __future__ import annotations

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from midden.llm import tokens


@pytest.mark.parametrize("name,word_ends,one", [("byte_bpe_50k.json", False, [64, 220, 50256, 275]), ("word_bpe_49k.json", True, [320, 49407, 321])])
def test_added_tokens(name, word_ends, one):
    texts = ["a <|endoftext|> b", "", "plain, words.", "x<|endoftext|><|startoftext|>y  <|endoftext|>\n", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|>", "last"]
    fresh = Tokenizer.from_file(P.path(name))
    flat, ends = tokens.Encoder(P.path(name), word_ends).encode(pa.array(texts))
    got = [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == one
