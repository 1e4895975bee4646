"""Texts that hold an added token, against the unchanged tokenizer."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tallyweave.llm import token_files as tf
from tallyweave.llm.registry import TOKENIZER


def test_added_tokens_as_in_the_plain_call(spark):
    t, e = Tokenizer.from_file(TOKENIZER), tf.Encoder(TOKENIZER, added=True)
    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice(("a", " ", "\n", "é", "𝒳", "<|endoftext|>", "<|endof", "text|>", "1", "!")) for _ in range(draw.randrange(1, 12)))
        assert e.encode(text) == np.array([*t.encode(text, add_special_tokens=False).ids, 0], e.kind).tobytes(), repr(text)
    rows = [(1, "one"), (2, "a <|endoftext|> b"), (3, "<|endoftext|>"), (4, "four")]
    want, start = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tf.token_files(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER)
    assert sorted(map(tuple, got.collect())) == want and want[1][2] == 5
