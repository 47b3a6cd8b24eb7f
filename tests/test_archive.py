import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from callweave.functions.vectors import average_linkage, best_fit, first_fit
from callweave.operators import clips, dedup, graph, identity, lines, stats, transcripts

CALL = "id long, path string, filename string, contact_hint string, phone string, call_time timestamp, duration_sec double, size_bytes long, status string, dup_of long, dup_reason string, probe_key string"
T0 = dt.datetime(2024, 1, 1, 10, 0)


def call(i, size=100, sec=10.0, hint="a", status="pending", path=None, t=T0, dup=None, why=None, probe=None):
    return (i, path or f"/r/{i}.wav", f"{i}.wav", hint, None, t, sec, size, status, dup, why, probe)


def test_star_verification_leaves_out_members_that_differ_from_the_original(spark):
    calls = spark.createDataFrame([call(1, probe="x"), call(2, probe="y"), call(3, probe="y")], CALL)
    texts = spark.createDataFrame([], "id long, text string")
    out = dedup.mark_duplicates(calls.withColumn("call_time", F.lit(None).cast("timestamp")), texts)
    assert out.where("dup_of is not null").count() == 0


def test_two_pairs_in_a_minute_and_a_manual_choice(spark):
    rows = [call(i, size=i, sec=10.0 + i / 10) for i in range(4)]
    texts = spark.createDataFrame([(0, "hello there world"), (1, "hello there world"), (2, "something else now"), (3, "something else now")], "id long, text string")
    out = {r.id: r for r in dedup.mark_duplicates(spark.createDataFrame(rows, CALL), texts).collect()}
    assert [out[i].dup_of for i in range(4)] == [None, 0, None, 2] and out[1].status == "skipped"
    manual = [call(1, dup=2, why="手动指定"), call(2)]
    kept = {r.id: r for r in dedup.mark_duplicates(spark.createDataFrame(manual, CALL), spark.createDataFrame([(1, "t"), (2, "t")], "id long, text string")).collect()}
    assert kept[1].dup_of == 2 and kept[1].dup_reason == "手动指定"


def test_originals_are_those_worked_on_and_chains_flatten(spark):
    rows = [call(1, status="analyzed", path="/backup/1.wav"), call(2)]
    texts = spark.createDataFrame([(1, "same"), (2, "same")], "id long, text string")
    out = {r.id: r.dup_of for r in dedup.mark_duplicates(spark.createDataFrame(rows, CALL), texts).collect()}
    assert out == {1: None, 2: 1}
    chain = spark.createDataFrame([call(1, dup=2), call(2, dup=3), call(3)], CALL)
    assert {r.id: r.dup_of for r in dedup.resolve_roots(chain).collect()} == {1: 3, 2: 3, 3: None}


def test_week_of_a_sunday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1),), (dt.datetime(2023, 1, 2),)], "t timestamp")
    assert [r.b for r in df.select(stats.bucket_name(F.col("t"), "week").alias("b")).collect()] == ["2023-W00", "2023-W01"]


def test_chunks_and_intervals(spark):
    seg = spark.createDataFrame([(1, 1, 0, 20000), (1, 2, 0, 1), (1, 3, 0, 20100)], "call_id long, id long, start_ms long, end_ms long")
    got = {}
    for r in transcripts.split_chunks(seg).collect():
        got.setdefault(r.seg_id, []).append((r.start_ms, r.end_ms))
    assert got == {1: [(0, 20000)], 2: [(0, 400)], 3: [(0, 20000), (20000, 20100)]}
    iv = spark.createDataFrame([(1, 0, 1000), (1, 1349, 2000), (1, 2350, 3000), (1, 9000, 9499)], "call_id long, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in transcripts.merge_intervals(iv).collect()) == [(0, 2000), (2350, 3000)]
    packs = transcripts.pack_batches(spark.createDataFrame([(1, s, c) for s, n in ((1, 2), (2, 2), (3, 5), (4, 1)) for c in range(n)], "call_id long, seg_id long, chunk_no int"))
    assert {r.seg_id: r.batch for r in packs.collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_stitching_shifts_words(spark):
    rows = [(1, 1, 20000, "b", "", [("w", 5, 9)]), (1, 0, 0, "a", "zh", [("v", 1, 2)]), (1, 2, 40000, " ", None, None)]
    r = transcripts.stitch_chunks(spark.createDataFrame(rows, "seg_id long, chunk_no int, start_ms long, text string, lang string, words array<struct<w:string,s:long,e:long>>")).first()
    assert (r.text, r.lang, r.blocks, r.empty_blocks) == ("ab", "zh", 3, 1) and [w.s for w in r.words] == [1, 20005]


def test_first_fit_and_best_fit_differ():
    e = np.eye(3)
    near = np.array([0.6, 0.8, 0.0])
    v = np.stack([e[0], e[1], near])
    assert first_fit(v, 0.55) == [0, 1, 0] and best_fit(v, 0.55) == [0, 1, 1]


def test_average_linkage():
    rng = np.random.default_rng(1)
    a, b = np.eye(8)[0] + rng.normal(0, 0.05, (5, 8)), np.eye(8)[1] + rng.normal(0, 0.05, (4, 8))
    assert average_linkage(np.vstack([b[:1], a, b[1:]])) == [0] + [1] * 5 + [0] * 3
    assert average_linkage(a) == [0] * 5 and average_linkage(a[:2]) == [0, 0] and average_linkage(a[:0]) == []


def centroid_rows(spark, vectors):
    return spark.createDataFrame([(i, "0", [float(x) for x in v], 1) for i, v in enumerate(vectors)], "call_id long, spk_local string, mean array<double>, n long")


def test_owner_needs_enough_calls(spark):
    e = np.eye(4)
    assert identity.bootstrap_me(centroid_rows(spark, [e[0]] * 4)).count() == 0
    for block in (3, 4096):
        r = identity.bootstrap_me(centroid_rows(spark, [e[0]] * 5 + [e[1], e[2]]), block=block).first()
        assert r.n_samples == 5 and abs(r.mean_embedding[0] - 1) < 1e-6


def test_blocked_matching_equals_the_broadcast_one(spark):
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(20, 6)))], "contact_id long, mean array<double>")
    s = spark.createDataFrame([(i, "other", None, [float(x) for x in rng.normal(size=6)]) for i in range(50)], "id long, who string, contact_id long, embedding array<double>")
    a = sorted(map(tuple, identity.match_contacts(s, c, 0.3).select("id", "contact_id").collect()))
    assert a == sorted(map(tuple, identity.match_contacts(s, c, 0.3, few=1).select("id", "contact_id").collect())) and a


def test_seats_are_not_merged_by_phone_and_names_survive(spark):
    rows = [(1, "line", "95588", None, "org", 5), (2, "line·A", "95588", None, "seat", 3), (3, "13800", "13800", None, None, 1), (4, "Ann", None, None, None, 0)]
    con = spark.createDataFrame(rows, "id long, name string, phone string, note string, kind string, n_calls long")
    assert identity.merge_same_phone(con).count() == 0
    m = spark.createDataFrame([(4, 3)], "drop_id long, keep_id long")
    out, moved = identity.apply_merges(con, m, {"s": spark.createDataFrame([(4,), (1,)], "contact_id long")})
    got = {r.id: r for r in out.collect()}
    assert got[3].name == "Ann" and 4 not in got and got[3].note == "" and {r.contact_id for r in moved["s"].collect()} == {3, 1}


def test_voices_merge_until_nothing_is_near(spark):
    e = np.eye(3)
    con = spark.createDataFrame([(i, f"n{i}", None, None, 1) for i in range(4)], "id long, name string, phone string, kind string, n_calls long")
    v = [e[0], e[0] + 0.1 * e[1], e[1], e[2]]
    vp = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "contact_id long, embedding array<double>")
    assert [tuple(r) for r in identity.merge_same_voice(con, vp, block=2, piece=3).collect()] == [(1, 0)]


def test_line_with_two_voices_is_split(spark):
    e = np.eye(4)
    cents = spark.createDataFrame([(i, [float(x) for x in e[i % 2]], 2) for i in range(6)], "call_id long, mean array<double>, n long")
    calls = spark.createDataFrame([(i, "line", "shared_line", "95588", None) for i in range(6)], "id long, contact_hint string, line_kind string, phone string, dup_of long")
    members = lines.line_voices(cents, calls)
    c = lines.split_decision(lines.cluster_line(members, calls))
    assert sorted(r.n_calls for r in c.collect()) == [3, 3]
    seats = spark.createDataFrame([("line", 9, [1.0, 0.0, 0.0, 0.0], "line·A")], "contact_hint string, seat_id long, mean array<double>, name string")
    claimed = lines.reuse_seats(c, seats)
    seg = spark.createDataFrame([(i, i, "other", "我叫李明") for i in range(1, 6, 2)], "call_id long, idx int, who string, text_zh string")
    named = {r.cluster: (r.seat_id, r.name) for r in lines.name_seats(c, members, seg, claimed, seats).collect()}
    assert named == {0: (9, "line·A"), 1: (None, "line·李明")}


def test_degree_counts_both_ends(spark):
    nodes = spark.createDataFrame([("me", "me", "x"), ("a", "contact", "a"), ("b", "contact", "b")], "node string, type string, label string")
    edges = spark.createDataFrame([("me", "a", "talked", 1, None, None)], "src string, dst string, kind string, weight long, call_id long, edge_time timestamp")
    n, e = graph.graph_slice(nodes, edges)
    assert {r.node: r.deg for r in n.collect()} == {"me": 2, "a": 2} and e.count() == 1
    assert graph.graph_elements(n, e).count() == 3


def test_clip_budget(spark):
    rows = [("s", f"w{i}", 0, 18000, "abc", 18.0, 0.2) for i in range(5)]
    got = clips.select_clips(spark.createDataFrame(rows, "speaker string, wav_path string, start_ms long, end_ms long, text_zh string, seconds double, energy double"))
    assert got.count() == 3
    e = spark.createDataFrame([(bytes(8),), (b"\x00\x40" * 4,), (None,)], "b binary").select(clips.clip_energy(F.col("b")).alias("e")).collect()
    assert [None if r.e is None else round(r.e, 6) for r in e] == [0.0, 0.25, None]


def test_separation_cohesion_and_seats_by_hand(spark):
    c = spark.createDataFrame([("l", "shared_line", 0, 3, [1.0, 0.0], 0.9), ("l", "shared_line", 1, 2, [0.6, 0.8], 0.8), ("l", "shared_line", 2, 2, [0.0, 1.0], 0.7), ("m", "person", 0, 2, [1.0, 0.0], 1.0)], "contact_hint string, line_kind string, cluster int, n_calls int, mean array<double>, intra double")
    assert [(r.contact_hint, round(r.separation, 6)) for r in lines.cluster_separation(c).collect()] == [("l", 0.0)]
    assert sorted((r.contact_hint, r.cluster) for r in lines.split_decision(c).collect()) == [("l", 0), ("l", 1), ("l", 2)]
    assert {(r.contact_hint, r.cluster): r.intra for r in lines.cluster_cohesion(c).collect()}[("l", 1)] == 0.8
    seg = spark.createDataFrame([(1, "o", [2.0, 0.0]), (2, "o", [0.0, 3.0]), (3, "o", [-1.0, 0.0]), (4, "p", [1.0, 0.0]), (5, "o", None)], "id long, org_id string, embedding array<double>")
    seats = spark.createDataFrame([("o", 7, [1.0, 0.0]), ("o", 8, [0.0, 1.0])], "org_id string, seat_id long, mean array<double>")
    assert sorted((r.id, r.seat_id) for r in lines.seat_for(seg, seats).collect()) == [(1, 7), (2, 8)]
