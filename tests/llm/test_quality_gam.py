import random
import zlib

import numpy as np
import pytest

from callweave.llm.quality_gam import FEATURES, fit, measure, quarters, score, sigmoid, train, tree


def test_tree_finds_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        g, h = rng.normal(size=12), rng.random(12) * 5 + 2
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        want = max(range(1, 12), key=lambda c: gain(0, c) + gain(c, 12))
        got = tree(g, h, leaves=2)
        assert np.allclose(got[:want], -g[:want].sum() / (h[:want].sum() + 1)) and np.allclose(got[want:], -g[want:].sum() / (h[want:].sum() + 1))
    assert len(set(tree(g, h).round(12))) == 3 and not tree(np.zeros(5), np.zeros(5)).any()


def test_quarters_find_the_best_cross():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h = rng.normal(size=(5, 6)), rng.random((5, 6)) + 2

        def gain(i, j):
            return sum(g[a, b].sum() ** 2 / (h[a, b].sum() + 1) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None)))

        want = max(((i, j) for i in range(1, 5) for j in range(1, 6)), key=lambda p: gain(*p))
        got, value = quarters(g, h)
        assert np.isclose(got, gain(*want) - g.sum() ** 2 / (h.sum() + 1))
        assert np.isclose(value[0, 0], -g[: want[0], : want[1]].sum() / (h[: want[0], : want[1]].sum() + 1))


def test_pairs_learn_what_no_single_feature_shows():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    aside = np.arange(4000) % 4 == 0
    model = fit(x, y, aside, cycles=120)
    assert (2, 7) in model.pairs and ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(6)
    x = rng.random((600, len(FEATURES)))
    model = fit(x, (x[:, 0] + 0.3 * rng.normal(size=600) > 0.5).astype(float), np.arange(600) % 4 == 0, cycles=40)
    for row in x[:40]:
        b = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        z = model.bias + sum(t[i] for t, i in zip(model.tables, b)) + sum(t[b[i] * 16 // 64, b[j] * 16 // 64] for t, (i, j) in zip(model.pair_tables, model.pairs))
        assert np.isclose(model.score(row[None])[0], sigmoid(z))


@pytest.mark.parametrize("text", [None, "", " \n", "\x1c", "x", "Ünderあ ab|12 😀 #", "w " * 50_000])
def test_features_are_finite(text):
    assert len(measure(text)) == len(FEATURES) and np.isfinite(measure(text)).all()


def test_features_by_hand():
    f = dict(zip(FEATURES, measure("Ab cd| cd|\nCD12 é!")))
    assert np.isclose(f["words"], np.log(6)) and np.isclose(f["word_length"], 14 / 5) and np.isclose(f["bars"], 2 / 14) and np.isclose(f["shouts"], 1 / 14)
    assert np.isclose(f["capitals"], 3 / 9) and np.isclose(f["digits"], 2 / 14) and np.isclose(f["not_ascii"], 1 / 14) and np.isclose(f["capital_words"], 2 / 5) and np.isclose(f["top_word"], 2 / 5)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(w if good else w.upper() + rng.choice(["!!", "##", " |"]) for w in words), "score"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_switches(spark):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in labels]
    wrong = [(i, 1 - y if h else y) for (i, y), h in zip(labels, held)]
    made = lambda x: {r.doc_id: r for r in score(docs, train(docs, spark.createDataFrame(x, "doc_id long, quality int"))).collect()}
    got = made(labels)
    assert all(got[i].held_out == h for (i, _), h in zip(labels, held)) and sum(held) > 90
    assert all((got[i].score >= 0.5) == (got[i].predicted == 1) and 0 <= got[i].score <= 1 for i, _ in labels)
    assert sum(got[i].predicted == y for (i, y), h in zip(labels, held) if h) >= 0.97 * sum(held)
    assert {i: r.score for i, r in made(wrong).items()} == {i: r.score for i, r in got.items()}  # held-out labels teach nothing


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "w " * 200_000), (None, "A b c")], "doc_id long, text string")
    for labels in ([], [(2, 1), (3, 0)], [(1, None), (3, 1), (3, 0), (None, 0), (77, 1), (2, 5)]):
        got = score(docs, train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {False}
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert score(docs.limit(0), train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 0
