import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_line_dedup import slow
from tests.llm.test_simhash_dedup import slow_components, slow_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90")
    columns = docs.columns
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    a = sorted((r.doc_id, r.text) for r in first.collect())
    assert first.columns == columns and 40 < len(a) < 90

    second = corpus_pipeline.line_dedup(spark, first, SF)
    rows = second.collect()
    gone = slow(spark, a)
    assert second.columns == columns and all(r.n_chars == len(r.text) for r in rows)
    b = {k: "\n".join(x for no, x in enumerate(t.split("\n")) if (k, no) not in gone) for k, t in a}
    assert {r.doc_id: r.text for r in rows} == b

    third = corpus_pipeline.simhash_near_dedup(spark, second, SF)
    ids = sorted(b)
    comp = slow_components([slow_fingerprint(b[i]) for i in ids])
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == [i for k, i in enumerate(ids) if comp[k] == k]

    fourth = corpus_pipeline.mixing(spark, third, SF)
    c = sorted((r.doc_id, r.text) for r in fourth.collect())
    assert fourth.columns == columns and {i for i, _ in c} == {i for k, i in enumerate(ids) if comp[k] == k} and len(c) < 2.2 * len(ids)

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.sentence_pieces(spark, fourth, SF).collect())
    assert got == sorted((i, hashlib.sha256(np.array(lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for i, t in c)


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "x " * 99, None, "a", None)], docs.schema)
    for table in (docs, odd):
        for name, stage in corpus_pipeline.STAGES:
            before, table = table, stage(spark, table, SF)
            if name != "sentence pieces":
                assert table.columns == before.columns and table.schema.simpleString() == before.schema.simpleString(), name
            # the rules reject both odd texts and the empty table has none
            assert table.count() == 0, name


def test_later_stages_keep_odd_rows(spark):
    """Null and empty texts, a null key and source, and equal rows, by what each stage's docstring says."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "a", 3), (3, "one two three four five", "en", "a", 23), (3, "one two three four five", "en", "a", 23), (None, "six seven eight nine ten", "en", "a", 24)]
    docs = spark.createDataFrame(rows, schema)
    key = lambda r: tuple((x is not None, x) for x in r)
    lines = sorted(map(tuple, corpus_pipeline.line_dedup(spark, docs, SF).collect()), key=key)
    assert lines == sorted([*rows[:2], (2, None, "en", "a", None), *rows[3:]], key=key)
    near = sorted(map(tuple, corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()), key=key)
    assert near == sorted([rows[0], rows[1], rows[3], rows[5]], key=key)
    mixed = [tuple(r) for r in corpus_pipeline.mixing(spark, docs, SF).collect()]
    assert set(mixed) == set(rows) and all(mixed.count(r) >= rows.count(r) for r in rows)
    pieces = corpus_pipeline.sentence_pieces(spark, docs, SF).collect()
    empty = {r.ids_sha256 for r in pieces if r.doc_id in (1, 2)}
    assert len(pieces) == len(rows) and len(empty) == 1


def test_run_is_its_stages_and_keeps_columns_of_any_name(spark, tmp_path):
    """Columns named like those that the operators add come through, whatever the case of their letters."""
    more = {"n_tokens": "t", "weight": "w", "Epoch": "e", "block_key": "b", "n_lines": "l", "n_removed": "r", "own_weight": "o"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(v), F.col("doc_id").cast("string")).alias(c) for c, v in more.items()])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        table = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert table.columns == docs.columns and table.count() > 20
        assert table.where(" or ".join(f"not {c} <=> concat('{v}', doc_id)" for c, v in more.items())).isEmpty()
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_line_stage_finds_lines_whose_words_differ(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, line, "en", "a", 1), (2, line.replace("delta", "dalto").replace("zeta", "zita"), "en", "a", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert {r.doc_id: r.text for r in stage(spark, docs, SF).collect()} == {1: line, 2: ""}
