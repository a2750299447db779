"""Ids of texts that a pattern or a vocabulary finds hard, against the contract's tokenizer."""

import numpy as np
import pytest
import tokenizers

from inkwell.llm import packing


@pytest.fixture(scope="module")
def both():
    tokenizer = tokenizers.Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    vocabulary = packing.Vocabulary(packing.vocabulary_path())
    return lambda t: (np.frombuffer(vocabulary.ids(t), "<u4").tolist(), tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a " + " " * 1_200_000 + "\n　b c", "\n" * 1_100_000 + "x", "x" + "\x85" * 100_000])
def test_long_white_space(both, text):
    got, expected = both(text)
    assert got == expected


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|endoftext|>", "a \n<|endoftext|><|endoftext|>\n b<|endoftext|", "<|endoftext|>" + " " * 1_000_000 + "<|endoftext|>x"])
def test_added_tokens(both, text):
    got, expected = both(text)
    assert got == expected and 50256 in got
