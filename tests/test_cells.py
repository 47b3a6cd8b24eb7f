import numpy as np
import pytest

from callweave.functions.cells import cells_of, near_links, nearest
from callweave.functions.components import components
from callweave.operators import identity


def vectors(rng, n, kinds, noise, dim=16):
    base = rng.normal(size=(kinds, dim))
    v = base[rng.integers(0, kinds, n)] / 4 + rng.normal(0, noise, (n, dim)) / 4
    return v / np.linalg.norm(v, axis=1)[:, None]


def frame(spark, v, key="id", name="v", start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in x]) for i, x in enumerate(v)], f"{key} long, {name} array<double>")


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    t, q = vectors(rng, 300, 10, 0.3), vectors(rng, 60, 12, 0.5)
    cells, dealt = cells_of(frame(spark, t, "t", "mean"), "t", "mean", ring=0.2, block=50)
    bound = cells.least(q)
    ring = {r.t: r._ring for r in dealt.collect()}
    angle = np.arccos(np.clip(q @ t.T, -1, 1))
    assert all((bound[:, ring[j]] <= angle[:, j] + 1e-9).all() for j in range(len(t)))


@pytest.mark.parametrize("noise,block,piece", [(0.2, 4096, 50_000), (1.0, 20, 40)])
def test_nearest_equals_the_matrix(spark, noise, block, piece):
    rng = np.random.default_rng(2)
    t, q = vectors(rng, 250, 12, noise), vectors(rng, 120, 14, noise)
    t[10], t[200] = t[5], t[5]  # ties go to the smallest
    q[0] = t[5]
    got = {r.id: (r.contact_id, r.sim) for r in nearest(frame(spark, q).repartition(3), frame(spark, t, "contact_id", "mean", 1000), 0.55, "id", "contact_id", pivots=6, block=block, piece=piece).collect()}
    s = q @ t.T
    want = {i: 1000 + int(r.argmax()) for i, r in enumerate(s) if r.max() >= 0.55}
    assert {i: k for i, (k, _) in got.items()} == want and want[0] == 1005
    assert all(np.isclose(x, s[i].max()) for i, (_, x) in got.items())


def test_a_query_meets_few_cells(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    near = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(base[rng.integers(0, 40, n)] + rng.normal(0, 0.2, (n, 32)))
    t, q = near(1600), near(200)
    got = nearest(frame(spark, q), frame(spark, t, "contact_id", "mean"), 0.55, "id", "contact_id").collect()
    assert len(got) == 200 and all(r.contact_id == int((q[r.id] @ t.T).argmax()) for r in got)
    assert sum(r.looked for r in got) < 0.15 * 200 * 1600


def test_matching_beyond_the_broadcast_is_the_same(spark):
    rng = np.random.default_rng(4)
    c = frame(spark, vectors(rng, 90, 20, 0.3), "contact_id", "mean")
    s = spark.createDataFrame([(i, "other", None, [float(x) for x in 3 * x]) for i, x in enumerate(vectors(rng, 80, 20, 0.4))] + [(900, "other", None, None), (901, "me", None, [1.0] * 16)], "id long, who string, contact_id long, embedding array<double>")
    a, b = ({r.id: (r.contact_id, round(r.sim, 9)) for r in identity.match_contacts(s, c, 0.5, few=few).collect()} for few in (100_000, 0))
    assert a == b and a
    assert identity.match_contacts(s, c.limit(0), 0.5, few=-1).count() == 0


@pytest.mark.parametrize("noise,block,piece", [(0.15, 2048, 2048), (0.4, 40, 60)])
def test_links_connect_what_all_pairs_connect(spark, noise, block, piece):
    rng = np.random.default_rng(5)
    v = vectors(rng, 260, 40, noise)
    v[100:180] = v[0] + rng.normal(0, 0.003, (80, 16))  # a large group
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = near_links(frame(spark, v, "contact_id", "mean"), 0.8, "contact_id", pivots=6, block=block, piece=piece)
    got = {r.node: r.component for r in components(links).collect()}
    low = np.arange(len(v))
    near = v @ v.T >= 0.8
    for _ in range(len(v)):
        low = np.array([low[n].min() for n in near])
    assert {i: int(k) for i, k in enumerate(low)} == {i: got.get(i, i) for i in range(len(v))}
    if block == 2048:
        pairs = (near.sum() - len(v)) // 2
        assert links.where("a is not null").count() < pairs  # a forest of each task, not its pairs


def test_far_pairs_are_not_looked_at(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([vectors(rng, 30, 1, 0.1, 48) for _ in range(40)])
    links = near_links(frame(spark, v, "contact_id", "mean"), 0.8, "contact_id")
    assert links.agg({"looked": "sum"}).first()[0] < 0.15 * len(v) ** 2


def merged(people, prints, threshold=0.8):
    """merge_same_voice by plain loops: (drop, keep)."""
    people, prints, out = dict(people), [list(p) for p in prints], {}
    while True:
        ids = sorted({c for c, _ in prints if c in people})
        mean = {c: np.mean([v for k, v in prints if k == c], axis=0) for c in ids}
        mean = {c: m / np.linalg.norm(m) for c, m in mean.items()}
        group = {c: c for c in ids}
        for a in ids:
            for b in ids:
                if a < b and mean[a] @ mean[b] >= threshold:
                    x, y = group[a], group[b]
                    group = {c: min(x, y) if g in (x, y) else g for c, g in group.items()}
        moves = {}
        for g in set(group.values()):
            own = [c for c in ids if group[c] == g]
            keep = min(own, key=lambda c: (people[c][0] in ("", people[c][1]), -people[c][2], c))
            moves |= {c: keep for c in own if c != keep}
        if not moves:
            return out
        out = {d: moves.get(k, k) for d, k in out.items()} | moves
        for p in prints:
            p[0] = moves.get(p[0], p[0])
        people = {c: v for c, v in people.items() if c not in moves}


def test_same_voices_equal_plain_loops(spark):
    rng = np.random.default_rng(7)
    v = vectors(rng, 160, 14, 0.35)
    people = {i: ((f"1380{i}" if i % 3 else f"n{i}"), f"1380{i}", int(rng.integers(0, 4))) for i in range(60)}
    prints = [(int(rng.integers(0, 60)) if i % 2 else i % 60, x) for i, x in enumerate(v)]
    con = spark.createDataFrame([(i, n, p, None if i % 5 else "person", k) for i, (n, p, k) in people.items()] + [(99, "x·A", "1", "seat", 9)], "id long, name string, phone string, kind string, n_calls long")
    vp = spark.createDataFrame([(c, [float(x) for x in x]) for c, x in prints] + [(99, [float(x) for x in v[0]])], "contact_id long, embedding array<double>")
    want = merged(people, prints)
    for search in ({}, {"block": 20, "piece": 30, "pivots": 3}):
        assert {r.drop_id: r.keep_id for r in identity.merge_same_voice(con, vp, **search).collect()} == want and want
