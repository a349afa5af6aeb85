"""Encoded ids against the library, text by text."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from urlatlas.llm.token_ids import Encoder

PARTS = ["a", "The", " ", "  ", "\n", "\t", "\r\n", "'s", "'S", "don't", "é", "É", "ß", "×", "÷", "…", "12", "3", "²", "-", "!!",
         " ", " ", "́", "İ", "ſ", "漢字", "😀", "<|endoftext|>", "word", " word", "\x0b", "\x1c", "\x00", "_", "ª"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    plain, cached = Tokenizer.from_file(path), Encoder(path, cache=500)
    rnd = random.Random(1)
    texts = ["", " ", "\n", "   ", "a  b", "a \n b", " lead", "trail ", "a   ", "x\n\n y"]
    texts += ["".join(rnd.choices(PARTS[:-14], k=rnd.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rnd.choices(PARTS, k=rnd.randint(1, 12))) for _ in range(2000)]
    texts += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert cached.kind
    for t in texts:
        assert np.frombuffer(cached.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_many_texts_at_once_have_the_ids_of_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name), cache=5)
        texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "x\ny z", "é à ü$$", "日本 x", "it's don't 12 34!", "a\t b", " \n ",
                 f"{e.added[0]} x y" if e.added else "x y", "word other word " * 50, "a", ""]
        want = [b"".join(i.to_bytes(4, "little") for i in e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        for size in (1, 40, 1 << 20):
            assert list(e.many(texts, size)) == want
        assert list(e.many([])) == []
