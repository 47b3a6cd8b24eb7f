import random
import re

import numpy as np
import xxhash

from callweave.llm.common import components
from callweave.llm.simhash_dedup import fingerprint, near_duplicates, near_links, spanning_links


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in ["", None, " \t\n", "One", "one TWO  three", "a b c d", "É a\x0bb\x0cc d e É a", "the cat sat on the mat " * 700, "x y z w v"]:
        assert fingerprint(t) == slow_fingerprint(t), t


def planted(n, seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**63, n, np.uint64)
    for i in range(n // 2, n):  # chains of points a few bits from an earlier one
        f[i] = f[int(rng.integers(0, i))] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))))
    return f


def test_links_equal_brute_force():
    for seed, n in enumerate([2, 50, 300, 900]):
        f = planted(n, seed)
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in spanning_links(f, leaf=32):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        assert [find(i) for i in range(n)] == slow_components(f.tolist())


def test_dense_ball_equals_brute_force():
    rng = np.random.default_rng(5)
    f = np.unique(np.array([sum(1 << int(b) for b in rng.choice(24, 3, replace=False)) for _ in range(800)], np.uint64))
    label = np.arange(len(f))
    for a, b in spanning_links(f, radius=1, leaf=16):
        assert (np.bitwise_count(f[a] ^ f[b]) >= 0).all()
    want = slow_components(f.tolist(), 4)
    for a, b in spanning_links(f, radius=4, leaf=16):
        for x, y in zip(a, b, strict=True):
            label[label == max(label[x], label[y])] = min(label[x], label[y])
    assert len(set(label.tolist())) == len(set(want))


def test_search_over_shards(spark):
    f = np.unique(planted(600, 9))
    rows = [(int(x), i) for i, x in enumerate(f.view(np.int64))]
    found = components(near_links(spark.createDataFrame(rows, "fp long, rep long"), shard=50)).collect()
    got = {r.node: r.component for r in found}
    assert [got.get(i, i) for i in range(len(f))] == slow_components(f.tolist())


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base + " end", "x"), (9, base, "x"), (9, base, "x"), (1, None, None), (2, "", "y"), (7, "short", "z"), (None, base, "q"), (8, "w " * 20000, "k")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"), shard=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    comp = slow_components(fps)
    for k, i in enumerate(ids):
        same = [ids[j] for j in range(len(ids)) if comp[j] == comp[k] and ids[j] is not None]
        assert by[i].component == min(same) and by[i].fp % 2**64 == fps[k]


def test_empty_and_null_keys(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = near_duplicates(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert r[0].component is None


def test_rows_without_a_key_link_others(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    f = [slow_fingerprint(t) for t in texts]
    far = lambda i, j: bin(f[i] ^ f[j]).count("1")
    i, j, k = next((i, j, k) for j in range(80) for i in range(80) for k in range(80) if far(i, j) <= 4 and far(j, k) <= 4 and far(i, k) > 4)
    got = near_duplicates(spark.createDataFrame([(1, texts[i]), (None, texts[j]), (2, texts[k])], "doc_id long, text string")).collect()
    assert {r.component for r in got} == {1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
