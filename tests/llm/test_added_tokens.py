"""Ids of texts that hold an added token's content, against the vocabulary file as it is."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from cadenza.llm import packing, tokens

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>\n日本語<|endoftext|>é", "<|endoftext", "word <|endoftext|> " * 50, "plain text", "", None]


def test_pieces_have_the_file_s_ids(spark):
    plain = Tokenizer.from_file(tokens.vocabulary())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted(map(tuple, packing.pieces(docs, 64).collect()))
    want = []
    for i, text in enumerate(TEXTS):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 64))]
    assert got == sorted(want)
    assert tokens.ids(TEXTS[0]) == [64, 50256, 65]
