import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from callweave.llm.sentence_pieces import CharacterMap, Known, Model, decode, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "   a  b ", "\n\n x\ty", "▁a ▁▁ b▁", "日本語 🙂 é", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 700, "\u0000 x", "İſKﬁ", "\r\n", "é", "ab" * 500 + "."]
    return odd + ["".join(rng.choice("abcdeth in er  \n.!é7▁日") for _ in range(rng.randrange(300))) for _ in range(200)]


def test_ids_and_text_equal_the_library(lib, texts):
    m, known = Model(PATH), Known()
    for t, (ids, _, _) in zip(texts, m.encode(texts, known), strict=True):
        assert ids.tolist() == lib.encode(t or ""), repr(t)[:80]
        assert m.decode(ids) == lib.decode(ids.tolist()), repr(t)[:80]


def test_spans_project_to_the_original(lib, texts):
    m = Model(PATH)
    for t, (ids, begin, end) in zip(texts, m.encode(texts, Known()), strict=True):
        raw = (t or "").encode()
        pos = 0
        for i, b, e in zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True):
            assert b == pos
            pos = e
            got = m.surface[i].replace(b" ", "▁".encode())
            assert raw[b:e].replace(b" ", "▁".encode()) in (got, got[3:] if b == 0 else got)
        assert pos == len(raw)


def test_decoding_of_any_ids(lib):
    m, rng = Model(PATH), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert m.decode(np.array(ids, np.int64)) == lib.decode(ids), ids


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_compiled_character_map(squeeze, dummy):
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(rules.serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix = dummy
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = Model.__new__(Model)
    m.read(proto)
    rng = random.Random(6)
    odd = ["", " ", "Ａ ｂ  ﬁ", "  ㌔グラム Ⅷ ​ x ", "ÀÉé ™", "\t\n a", "ＡＢＣ", "①②", "ß İ", "a 　 b"]
    odd += ["".join(rng.choice("aB É①ﬁ　  \n™éＺ") for _ in range(rng.randrange(30))) for _ in range(200)]
    for t, (ids, begin, end) in zip(odd, m.encode(odd, Known()), strict=True):
        assert ids.tolist() == lib.encode(t), repr(t)
        norm, source = m.normalise(t)
        assert (begin <= end).all() and (np.diff(end) >= 0).all() and (not len(end) or end[-1] <= len(t.encode()))
    assert CharacterMap(spec.normalizer_spec.precompiled_charsmap).longest("Ａx".encode(), 0) == (3, b"a")


def test_queries_over_rows(spark, lib, texts):
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[3], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.ids_sha256): r for r in digests(df, PATH).collect()}
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        r = got[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r.n_span_bytes == len((t or "").encode())
    both = decode(encode(df, PATH), PATH)
    assert {(r.doc_id, r.text) for r in both.collect()} == {(i, lib.decode(lib.encode(t or ""))) for i, t, _ in rows}
    assert digests(df.limit(0), PATH).count() == 0


def test_long_chunks_equal_the_library_in_bounded_time():
    import random
    import time

    import public_tokenizers
    import sentencepiece

    from callweave.llm.sentence_pieces import Known, model

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000)), "a" * 100_000, "ab" * 20_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50_000)), "é🙂x" * 2000, "x" * 1001]
    began = time.time()
    got = [(ids.tolist(), end[-1]) for ids, _, end in model(path).encode(texts, Known())]
    assert time.time() - began < 60
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [i for i, _ in got] == [lib.encode(t) for t in texts] and [e for _, e in got] == [len(t.encode()) for t in texts]
