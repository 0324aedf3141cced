"""Packing's ids equal those of tokenizers where texts hold added tokens' strings."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protospan.llm import packing
from protospan.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def test_ids_equal_those_of_tokenizers():
    with open(PATH, "rb") as f:
        encode = packing.text_encoder(f.read(), added=True)
    rng, parts = random.Random(3), [END, END, "a", " b", "  ", "\n", "\n\n", "<|", "|>", "endoftext", "don't", "Ä", "日本"]
    texts = [f"a{END}b", END, END * 3, f" {END} ", f"x \n{END}\n y", END[:-1]] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(500)]
    whole = Tokenizer.from_file(PATH)
    assert whole.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_the_query_packs_added_tokens(spark, tmp_path):
    text = f"a{END}b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = QUERIES["op5_best_fit_packing"](spark, str(tmp_path)).collect()
    assert row.length == 4 and row.ids_crc32 == zlib.crc32(np.array([64, 50256, 65, packing.END], "<u4").tobytes())


def test_the_longest_added_token_counts():
    with open(PATH, "rb") as f:
        spec = json.loads(f.read())
    spec["added_tokens"] += [spec["added_tokens"][0] | {"id": 50257, "content": END + "x"}]
    raw = json.dumps(spec)
    encode, whole = packing.text_encoder(raw.encode(), added=True), Tokenizer.from_str(raw)
    for t in (f"a{END}x b", f"{END}{END}xx"):
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added tokens"):
        packing.text_encoder(json.dumps(spec).encode(), added=True)
