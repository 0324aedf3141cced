"""Texts are encoded whole: what new words cost does not add up call by call."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from protospan.llm import packing

ODD = ["", " ", "\n\n\n x", "a  b \t\n c d", "é​\U0001f600", "it's we'll I'd", " " * 5000, "x" * 20000, "1" * 3000, "\t \t" * 3000, "a  b\r\n\r\nc "]


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def test_one_call_a_text(raw, monkeypatch):
    calls = []

    class Counted(tiktoken.Encoding):
        def encode_ordinary(self, text):
            calls.append(text)
            return super().encode_ordinary(text)

        def encode_to_numpy(self, text, **kw):
            calls.append(text)
            return super().encode_to_numpy(text, **kw)

    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    encode = packing.text_encoder(raw, added=True)
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(2000))
    assert len(encode(text)) > 4 * 2000 and len(calls) == 1


def test_odd_texts_equal_tokenizers(raw):
    encode, whole = packing.text_encoder(raw, added=True), Tokenizer.from_str(raw.decode())
    for text in ODD:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
