import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions.leaders import followed, joined_up, leaders, settle, sortable
from callweave.functions.vectors import best_fit
from callweave.operators import identity, lines


def vectors(rng, n, kinds, noise, dim=12):
    v = np.eye(dim)[rng.integers(0, kinds, n)] + rng.normal(0, noise, (n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


def loop(v, threshold, best=True):
    """The plain loop with fixed leaders: (leaders, leader of each row)."""
    lead, own = [], []
    for i, x in enumerate(v):
        near = [(float(x @ v[j]), j) for j in lead if x @ v[j] >= threshold]
        if near:
            own.append(max(near, key=lambda p: (p[0], -p[1]))[1] if best else min(j for _, j in near))
        else:
            lead.append(i)
            own.append(i)
    return lead, own


def test_settle_equals_the_loop():
    rng = np.random.default_rng(1)
    for noise in (0.05, 0.3, 1.0):
        v = vectors(rng, 200, 6, noise)
        assert np.flatnonzero(settle(v, 0.55)).tolist() == loop(v, 0.55)[0]


@pytest.mark.parametrize("parts,block,piece", [(1, 4096, 50_000), (7, 90, 100), (64, 50, 70)])
def test_rounds_equal_the_loop_on_any_partitions(spark, parts, block, piece):
    rng = np.random.default_rng(2)
    groups = {"a": vectors(rng, 220, 6, 0.3), "b": vectors(rng, 30, 3, 0.4), "c": vectors(rng, 1, 1, 0.1)}
    rows = [(g, i, [float(x) for x in v]) for g, m in groups.items() for i, v in enumerate(m)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, int(i), v) for g, i, v in rows], "g string, i long, v array<double>").repartition(parts)
    lead = leaders(df, 0.55, "g", "i", "v", block, piece)
    want = {g: loop(m, 0.55) for g, m in groups.items()}
    assert {(r.g, r.i) for r in lead.collect()} == {(g, i) for g, (x, _) in want.items() for i in x}
    for best in (True, False):
        got = {(r.g, r.i): r.leader for r in followed(df, lead, 0.55, "g", "i", "v", best, block, piece).collect()}
        assert got == {(g, i): k for g, m in groups.items() for i, k in enumerate(loop(m, 0.55, best)[1])}


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, i long, v array<double>")
    assert leaders(df, 0.5, "g", "i").count() == 0 and followed(df, leaders(df, 0.5, "g", "i"), 0.5, "g", "i").count() == 0


def test_numbers_sort_as_text(spark):
    n = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, 255, 4096]
    got = spark.createDataFrame([(x,) for x in n], "x long").orderBy(sortable(F.col("x"))).collect()
    assert [r.x for r in got] == sorted(n)


def test_clusters_join_until_nothing_is_near(spark):
    v = {"a": (3, [3.0, 0.0, 0.0]), "b": (1, [0.7, 0.7, 0.0]), "c": (2, [0.0, 0.0, 2.0]), "d": (1, [0.75, 0.7, 0.0])}
    df = spark.createDataFrame([("g", k, n, x) for k, (n, x) in v.items()], "g string, first string, size long, total array<double>")
    for block in (2,):
        assert {r.first: r.to for r in joined_up(df, 0.7, "g", block).collect()} == {"a": "a", "b": "a", "c": "c", "d": "a"}


def owner_rows(seed=8):
    rng = np.random.default_rng(seed)
    e = np.eye(12)
    rows = [(i, "0", e[0] + rng.normal(0, 0.05, 12)) for i in range(60)] + [(i, "1", e[1 + i % 11] + rng.normal(0, 0.05, 12)) for i in range(60)]
    return [(c, s, [float(x) for x in v / np.linalg.norm(v)], 1) for c, s, v in rows]


def test_the_owner_is_the_same_on_any_partitions(spark):
    rows = owner_rows()
    df = spark.createDataFrame(rows, "call_id long, spk_local string, mean array<double>, n long")
    got = [identity.bootstrap_me(df.repartition(k), block=b).first() for k, b in ((1, 4096), (7, 45))]
    want = np.mean([v for _, s, v, _ in rows if s == "0"], axis=0)
    for r in got:
        assert r.n_samples == 60 and np.allclose(r.mean_embedding, want / np.linalg.norm(want), atol=1e-6)


def test_new_voices_equal_the_loop_and_bring_contacts(spark):
    rng = np.random.default_rng(3)
    v = vectors(rng, 150, 8, 0.3)
    seg = spark.createDataFrame([(i, i // 4, "other", None, [float(x) for x in 3 * x]) for i, x in enumerate(v)], "id long, call_id long, who string, contact_id long, embedding array<double>")
    found = identity.new_voice_contacts(seg, block=60)
    lead, own = loop(v, 0.55)
    assert {r.id: (r.first_id, r.name) for r in found.collect()} == {i: (k, f"未知声纹{k}") for i, k in enumerate(own)}
    con = spark.createDataFrame([(1, "Ann", None)], "id long, name string, note string")
    prints = spark.createDataFrame([], "contact_id long, embedding array<double>, source_call_id long, source_segment_id long, quality double")
    for _ in range(2):  # a second run adds nothing
        seg, con, prints = identity.add_new_voices(found, seg, con, prints)
        ids = {r.name: r.id for r in con.collect()}
        assert len(ids) == len(lead) + 1 == con.count() and all(i < 0 for n, i in ids.items() if n != "Ann")
        assert {r.id: (r.contact_id, r.contact_conf) for r in seg.collect()} == {i: (ids[f"未知声纹{k}"], 0.7) for i, k in enumerate(own)}
        assert sorted((r.source_segment_id, r.contact_id, r.quality) for r in prints.collect()) == [(k, ids[f"未知声纹{k}"], 0.6) for k in lead]


def test_lines_against_the_plain_loop(spark):
    """Separated voices: the loop's clusters. Noisy ones: which calls go together agrees in 85 of 100 pairs or more."""
    rng = np.random.default_rng(5)
    for noise, least in ((0.08, 1.0), (0.25, 0.85)):
        v = vectors(rng, 120, 4, noise, 8)
        cents = spark.createDataFrame([(i, [float(x) for x in x], 2) for i, x in enumerate(v)], "call_id long, mean array<double>, n long")
        calls = spark.createDataFrame([(i, f"l{i % 2}" if i < 119 else "one", "shared_line", "9", None) for i in range(120)], "id long, contact_hint string, line_kind string, phone string, dup_of long")
        got = [sorted((r.contact_hint, r.call_id, r.cluster) for r in lines.line_voices(cents.repartition(k), calls, block=b, piece=p).collect()) for k, b, p in ((1, 4096, 50_000), (7, 30, 40))[: 1 if least == 1.0 else 2]]
        assert got[0] == got[-1] and len(got[0]) == 119
        for line in (0, 1):
            ids = [i for i in range(119) if i % 2 == line]
            own = {i: k for _, i, k in got[0]}
            want = dict(zip(ids, best_fit(v[ids], 0.5)))
            same = [(own[a] == own[b]) == (want[a] == want[b]) for a in ids for b in ids if a < b]
            assert np.mean(same) >= least
            if least == 1.0:
                assert [own[i] for i in ids] == [want[i] for i in ids]
        if least == 1.0:
            continue
        members = spark.createDataFrame([(*r, [float(x) for x in v[r[1]]]) for r in got[0]], "contact_hint string, call_id long, cluster int, v array<double>")
        for r in lines.cluster_line(members, calls).collect():
            x = np.array([v[i] for h, i, k in got[0] if (h, k) == (r.contact_hint, r.cluster)])
            m = x.sum(0) / np.linalg.norm(x.sum(0))
            assert r.n_calls == len(x) and np.allclose(r.mean, m) and np.isclose(r.intra, (x @ m).mean())


def test_separation_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = vectors(rng, 40, 8, 0.5)
    c = spark.createDataFrame([("l", k, [float(x) for x in x]) for k, x in enumerate(v)] + [("m", 0, [1.0] + [0.0] * 11)], "contact_hint string, cluster int, mean array<double>")
    want = min(float(a @ b) for i, a in enumerate(v) for b in v[:i])
    for piece in (15, 4096):
        got = {r.contact_hint: r.separation for r in lines.cluster_separation(c, piece).collect()}
        assert list(got) == ["l"] and np.isclose(got["l"], want)
