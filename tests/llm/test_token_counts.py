import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callweave.llm.token_counts import Merger, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["", None, " ", "\n\n  x", "aaaaaaaaaaaa", "it's we'll THEY'RE", "naïve Ünïcode 日本語 🙂🙂", "a<|endoftext|>b <|endoftext|>", "1234567890" * 30, " 　 x\r\n\t", "﻿x\u0000y"]
    return odd + ["".join(rng.choice("abcdeth in er  \n.!é7") for _ in range(rng.randrange(400))) for _ in range(120)] + ["x" * 5000]


def test_counts_equal_the_library(spark, texts):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()}
    for i, t in enumerate(texts):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 512), repr(t)[:60]


def test_symbols_equal_the_library():
    m, lib = Merger(PATH), Tokenizer.from_file(PATH)
    words = ["banana", " thonerereat", "aaaaa", " ", "é", "x"]
    flat, n = m.merge([w.encode() for w in words])
    assert flat.tolist() == [i for w in words for i in lib.encode(w, add_special_tokens=False).ids] and len(n) == len(words)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_pretokens_equal_the_library_in_bounded_time():
    import random
    import time

    import public_tokenizers
    import tokenizers

    from callweave.llm.token_counts import merger

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "a" * 100_000, "ab" * 20_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50_000)), "x" * 1001, "=" * 5000]
    began = time.time()
    got = merger(path).counts(texts, {})
    assert time.time() - began < 60
    lib = tokenizers.Tokenizer.from_file(path)
    assert got == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
