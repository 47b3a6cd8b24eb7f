import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions.vectors import average_linkage, norm
from callweave.operators import clips, dedup, identity, transcripts
from callweave.plans import chain
from callweave.plans.source_queries import chain_tables
from callweave.sources import recordings as rec

SF = "/root/testdata/sf0.001"


def rows_of(df):
    one = lambda x: tuple(round(v, 9) if isinstance(v, float) else tuple(round(e, 6) for e in v) if isinstance(v, list) and v and isinstance(v[0], float) else repr(v) for v in x)
    return sorted(map(repr, (one(r) for r in df.select(sorted(df.columns)).collect())))


def test_a_second_run_of_the_chain_changes_nothing(spark):
    t, listing = chain_tables(spark, SF)
    results = t["segments"].select("call_id", F.col("id").alias("seg_id"), F.lit(1).cast("long").alias("attempt"), F.concat(F.lit("R "), "text_zh").alias("text"), F.lit("en").alias("lang"), F.array(F.struct(F.lit("w").alias("w"), F.col("start_ms").alias("s"), (F.col("end_ms") - 1).alias("e"))).alias("words"), F.lit(None).cast("string").alias("error")).where("call_id % 2 = 0")
    one = chain.run_chain(t, listing, results)
    keep = ["calls", "segments", "contacts", "voiceprints", "me", "outputs"]
    two = chain.run_chain({k: one[k] for k in keep}, listing, results)
    for k in ("calls", "segments", "contacts", "outputs", "nodes", "edges"):
        assert rows_of(one[k]) == rows_of(two[k]), k
    seg = one["segments"]
    assert seg.count() == t["segments"].count() and seg.where("contact_id is not null and contact_conf is null").isEmpty()
    assert seg.where("align_source is not null").count() == results.count() == seg.where("text_zh like 'R %'").count()
    assert one["calls"].where("speaker_map is not null").count() == seg.select("call_id").distinct().count()
    named = seg.where("contact_id is not null").join(one["contacts"].select(F.col("id").alias("contact_id")), "contact_id", "left_anti")
    assert named.isEmpty() and seg.where("who = 'other' and contact_id is not null").count() > 0


def test_probe_keys_are_asked_for_candidates_only(spark):
    t, listing = chain_tables(spark, SF)
    asked = []

    def probe(files):
        asked.append(files.count())
        return files.select("path", F.sha2("path", 256).alias("probe_key"))

    same = t["calls"].withColumns({"size_bytes": F.when(F.col("id") < 6, 77).otherwise(F.col("size_bytes")), "duration_sec": F.when(F.col("id") < 6, 9.0).otherwise(F.col("duration_sec"))})
    listing = same.select("path", F.col("size_bytes").alias("length"), F.col("call_time").alias("modificationTime"))
    one = chain.settled(chain.scan_and_dedup(t | {"calls": same}, listing, probe=probe), "calls")
    got = one["calls"].where("probe_key is not null").count()
    assert got >= 5 and asked == [got] and asked[0] < 200
    chain.scan_and_dedup(one, listing, probe=probe)
    assert asked[1] == 0
    grown = listing.withColumn("length", F.when(F.col("path") == same.where("id = 2").first().path, 78).otherwise(F.col("length")))
    two = chain.scan_and_dedup(one, grown, probe=probe)["calls"]
    assert two.where("id = 2").first().probe_key is None and two.where("id = 3").first().probe_key


def test_probes_read_heads_and_tails_once(spark, tmp_path):
    import hashlib

    sizes = {"a.wav": 10, "b.wav": rec.SLICE, "c.wav": 2 * rec.SLICE, "d.wav": 2 * rec.SLICE + 1, "e.wav": 500_000}
    data = {n: random.Random(n).randbytes(k) for n, k in sizes.items()}
    for n, b in data.items():
        (tmp_path / n).write_bytes(b)
    listing = rec.list_recordings(spark, str(tmp_path)).unionByName(spark.createDataFrame([("/nowhere.wav", 5, None), (None, 1, None)], "path string, length long, modificationTime timestamp"))
    keys, n = rec.ensure_probes(listing, str(tmp_path / "keys"))
    want = {k: hashlib.sha256(str(len(b)).encode() + b[: rec.SLICE] + (b[-rec.SLICE :] if len(b) > 2 * rec.SLICE else b"")).hexdigest() for k, b in data.items()}
    assert n == 6 and {r.path.rsplit("/", 1)[1]: r.probe_key for r in keys.collect()} == want
    _, again = rec.ensure_probes(listing, str(tmp_path / "keys"))
    assert again == 1  # the file that can't be read is tried again
    (tmp_path / "a.wav").write_bytes(b"longer than before")
    keys, n = rec.ensure_probes(rec.list_recordings(spark, str(tmp_path)), str(tmp_path / "keys"))
    assert n == 1 and keys.count() == 5


@pytest.mark.parametrize("piece", [3, 40, 10_000])
def test_batches_equal_the_loop(spark, piece):
    rng = random.Random(piece)
    sizes = [(rng.randrange(9), s, rng.choice([1, 1, 2, 3, 4, 5, 9])) for s in range(300)]
    chunks = spark.createDataFrame([(c, s, k) for c, s, n in sizes for k in range(n)], "call_id long, seg_id long, chunk_no int").repartition(5)
    want, held, batch = {}, 0, 0
    for _, s, n in sorted(sizes):
        if held and held + n > 4:
            held, batch = 0, batch + 1
        held += n
        want[s] = (n, batch)
    assert {r.seg_id: (r.n_chunks, r.batch) for r in transcripts.pack_batches(chunks, piece=piece).collect()} == want
    assert transcripts.pack_batches(chunks.limit(0)).count() == 0


def slow_linkage(vectors, k=2):
    """Average linkage by always merging the nearest pair: distances of clusters as means over their members."""
    x = np.stack([norm(v) for v in vectors])
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    if len(groups) == 2 and float(norm(x[groups[0]].mean(0)) @ norm(x[groups[1]].mean(0))) > 0.8:
        return [0] * len(x)
    own = {i: g for g, m in enumerate(groups) for i in m}
    first = list(dict.fromkeys(own[i] for i in range(len(x))))
    return [first.index(own[i]) for i in range(len(x))]


def test_linkage_equals_merging_nearest_pairs():
    rng = np.random.default_rng(1)
    for n in (3, 4, 7, 20, 35):
        for k in (2, 3):
            v = rng.normal(size=(n, 5))
            assert average_linkage(v, k) == slow_linkage(v, k), (n, k)
    assert average_linkage(np.ones((6, 3))) == [0] * 6


def test_long_calls_are_linked_in_quadratic_time():
    import time

    rng = np.random.default_rng(2)
    v = np.eye(16)[rng.integers(0, 2, 4000)] + rng.normal(0, 0.3, (4000, 16))
    began = time.time()
    assert len(set(average_linkage(v))) == 2 and time.time() - began < 20


def test_a_second_result_changes_only_what_it_has(spark):
    seg = spark.createDataFrame([(1, "a", "first", 0, 9, "vad", 0.5), (2, "b", None, 10, 19, None, None), (3, "c", None, 20, 29, "old", 0.7)], "id long, text_zh string, text_sv string, start_ms long, end_ms long, align_source string, ts_confidence double")
    word = "array<struct<w:string,s:bigint,e:bigint>>"
    res = spark.createDataFrame([(1, "A", None), (2, "", [("w", 11, 18)])], f"seg_id long, text string, words {word}")
    got = {r.id: tuple(r)[1:] for r in transcripts.fold_refined(seg, res).collect()}
    assert got == {1: ("A", "first", 0, 9, "vad", 0.5), 2: ("b", None, 11, 18, "qwen3-aligner", 0.9), 3: ("c", None, 20, 29, "old", 0.7)}
    assert rows_of(transcripts.fold_refined(transcripts.fold_refined(seg, res), res)) == rows_of(transcripts.fold_refined(seg, res))


def test_assembling_keeps_the_columns_of_other_calls(spark):
    schema = "id long, call_id long, idx int, spk_local string, who string, contact_id long, contact_conf double, start_ms long, end_ms long, text_zh string, embedding array<double>"
    seg = spark.createDataFrame([(1, 7, 0, "1", "other", 5, 0.8, 0, 9, "x", [1.0]), (2, 8, 0, "0", "me", None, None, 0, 9, "gone", None)], schema)
    utt = spark.createDataFrame([(100, 8, 50, 2000, "<|zh|> b  c", [1.0]), (101, 8, 0, 40, "a", [1.0]), (102, 8, 60, 70, " <|x|> ", None)], "id long, call_id long, start_ms long, end_ms long, text string, embedding array<double>")
    labels = spark.createDataFrame([(100, 1), (101, -1)], "id long, speaker int")
    out = transcripts.assemble_segments(utt, seg, labels)
    assert out.columns == seg.columns
    got = {(r.call_id, r.idx): r for r in out.collect()}
    assert set(got) == {(7, 0), (8, 0), (8, 1)} and tuple(got[7, 0])[:7] == (1, 7, 0, "1", "other", 5, 0.8)
    assert (got[8, 0].text_zh, got[8, 0].spk_local, got[8, 0].embedding) == ("a", "-1", None) and (got[8, 1].text_zh, got[8, 1].spk_local, got[8, 1].embedding) == ("b c", "1", [1.0])
    assert got[8, 0].id < 0 and got[8, 0].id != got[8, 1].id


def test_clips_of_a_hot_speaker_equal_the_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["me", "me", "me", "a", "b"]), f"w{i % 90}", i, i + 5, "abc", rng.choice([1.5, 2.0, 6.25, 18.0]), rng.choice([0.0, 0.1, 0.2])) for i in range(400)]
    df = spark.createDataFrame(rows, "speaker string, wav_path string, start_ms long, end_ms long, text_zh string, seconds double, energy double")
    got = {(r.speaker, r.clip): (r.wav_path, r.start_ms) for r in clips.select_clips(df.repartition(6)).collect()}
    want = {}
    for who in ("me", "a", "b"):
        own = sorted((r for r in rows if r[0] == who and r[6] >= 1e-5), key=lambda r: (min(r[5], 12) * (1 if r[6] > 0.15 else 0.4), r[1], r[2]), reverse=True)
        total = 0.0
        for no, r in enumerate(own, 1):
            if total >= 40:
                break
            want[who, f"ref_{no:02d}"], total = (r[1], r[2]), total + r[5]
    assert got == want


def test_growth_of_a_hot_contact_stops_at_its_bound(spark):
    seg = spark.createDataFrame([(i, i // 3, 1 if i % 4 else 2, [1.0, float(i)]) for i in range(200)] + [(900, 1, None, [1.0, 0.0]), (901, 1, 3, None)], "id long, call_id long, contact_id long, embedding array<double>")
    prints = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], None), *[(2, [1.0, 0.0], None)] * 9], "contact_id long, embedding array<double>, source_segment_id long")
    got = identity.grow_voiceprints(seg.repartition(5), prints).collect()
    assert sorted(r.source_segment_id for r in got) == [2, 3, 5, 6, 7, 9] and {r.contact_id for r in got} == {1}


def test_rings_and_chains_of_marks(spark):
    marks = {1: 2, 2: 3, 3: None, 4: 5, 5: 4, 6: 1, 7: 99, **{i: 3 for i in range(100, 160)}}
    calls = spark.createDataFrame(list(marks.items()), "id long, dup_of long")
    got = {r.id: r.dup_of for r in dedup.resolve_roots(calls).collect()}
    assert got == marks | {1: 3, 6: 3} 


def test_groups_listed_are_the_first(spark):
    calls = spark.createDataFrame([(i, f"/p{i}", None if i < 5 else i % 4, "r") for i in range(30)], "id long, path string, dup_of long, dup_reason string")
    got = [(r.canonical, r.path, [c.id for c in r.copies]) for r in dedup.list_groups(calls, 2).collect()]
    assert got == [(0, "/p0", list(range(8, 30, 4))), (1, "/p1", list(range(5, 30, 4)))]
