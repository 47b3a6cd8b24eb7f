import math
import random
import re
from collections import Counter

import numpy as np

from callweave.llm.ranked_search import Ranks, Shard, item_terms, search, terms, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, top=10):
    """Every document scored for every item, by the formula as it is stated."""
    held = [(k, Counter(words(t)), len(words(t))) for k, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, want in wanted.items():
        rows = []
        for k, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in want if c[w])
            if s > 0:
                rows.append((-s, k is None, k or 0, k))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def corpus(n, seed, vocabulary=60):
    rng = random.Random(seed)
    pick = lambda: f"t{int(rng.paretovariate(0.7)) % vocabulary}"
    docs = [(i, rng.choice([" ", "-", "\n"]).join(pick() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, rng.choice(docs)[1].upper()) for i in range(n // 3)]
    items = [(i, " ".join(pick() for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    return docs, items


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ0 _-éあ\x7f\x80@[`{/:\x00\n") for _ in range(rng.randrange(40)))
        assert [w.decode() for w in terms(t)] == words(t)
    assert terms(None) == []


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, item int"), spark.createDataFrame([(*x, "r") for x in items], "item_id long, text string, rank string")


def test_search_equals_scoring_every_document(spark):
    docs, items = corpus(400, 2)
    docs += [(None, docs[0][1]), (None, "t1"), (5000, None), (5001, ""), (5002, " .. "), *docs[:5], (5003, "t1 " * 30_000), (5004, "t1 t2 " * 2)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "t1"), (3, "t2 t3"), (None, "t2")]
    d, q = frames(spark, docs, items)
    want = slow(docs, items)
    assert sorted((tuple(r) for r in search(d, q).collect()), key=repr) == want
    assert sorted((tuple(r) for r in search(d.repartition(7), q, block=100).collect()), key=repr) == want  # queries in blocks
    assert sorted((tuple(r) for r in search(d, q, top=3).collect()), key=repr) == slow(docs, items, 3)


def test_no_rows(spark):
    d, q = frames(spark, *corpus(5, 3))
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0
    assert search(d.limit(0), q).columns == ["item_id", "rank", "doc_id", "score"]
    assert item_terms(q).columns == ["item", "term"]


def shard(docs, n_terms_total=None):
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in docs for w in words(t)}))}
    at, term, tf, n = [], [], [], []
    for i, (_, t) in enumerate(docs):
        n.append(len(words(t)))
        for w, c in Counter(words(t)).items():
            at.append(i), term.append(vocabulary[w]), tf.append(c)
    df = Counter(term)
    weights = np.array([weight(len(docs), df[i]) for i in range(len(vocabulary))])
    return Shard([k for k, _ in docs], np.array(n), np.array(at), np.array(term, np.int32), np.array(tf, np.int32), weights, len(docs), sum(n)), vocabulary


def test_sparse_table_gives_maxima():
    docs, _ = corpus(200, 5, 12)
    s, vocabulary = shard(docs)
    rng = random.Random(6)
    for _ in range(500):
        t = rng.randrange(len(vocabulary))
        lo, hi = int(s.begin[t]), int(s.begin[t + 1])
        a = rng.randrange(lo, hi)
        b = rng.randrange(a + 1, hi + 1)
        assert s.maxima(np.array([a]), np.array([b]))[0] == a + int(np.argmax(s.impact[a:b]))


def test_intervals_are_left_and_the_ranks_stay_exact():
    rng = random.Random(7)
    docs = [(i, " ".join([f"c{rng.randrange(40)}" for _ in range(30)] + [f"r{i}"])) for i in range(4000)]
    docs += [(4000 + i, "c1 c2 c3 c4 c5 r17 r18 r19") for i in range(12)]
    rng.shuffle(docs)
    s, vocabulary = shard(docs)
    wanted = np.array(sorted(vocabulary[w] for w in "c1 c2 c3 c4 c5 r17 r18 r19".split()))
    for leaf in (1, 16, 10**9):
        ranks = Ranks(10)
        seen = s.search(wanted, ranks, leaf)
        assert [(k, -x) for x, (_, k) in ranks.rows] == [(k, v) for _, _, k, v in sorted(slow(docs, [(0, "c1 c2 c3 c4 c5 r17 r18 r19")]), key=lambda r: r[1])]
        if leaf == 16:
            assert seen < 0.5 * (s.begin[wanted + 1] - s.begin[wanted]).sum()
