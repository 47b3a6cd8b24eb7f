import itertools
import random
import zlib

import numpy as np

from callweave.llm.language_id import CHAIN, chains, features, fit, identify, label_words, marginals, train


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    size = np.array([3, 1, 4, 2])
    emit, trans, start = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, joint, first, norm = marginals(emit, size, trans, start, pairs=True)
    want, wjoint, wfirst, wnorm, at = np.zeros((10, 3)), np.zeros((3, 3)), np.zeros(3), 0.0, 0
    for n in size:
        paths = list(itertools.product(range(3), repeat=int(n)))
        s = np.array([start[p[0]] + sum(emit[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        z = np.logaddexp.reduce(s)
        wnorm += z
        for p, q in zip(paths, np.exp(s - z)):
            wfirst[p[0]] += q
            for i, y in enumerate(p):
                want[at + i, y] += q
            for a, b in zip(p, p[1:]):
                wjoint[a, b] += q
        at += n
    assert np.allclose(gamma, want) and np.allclose(joint, wjoint) and np.allclose(first, wfirst) and np.isclose(norm, wnorm)


def test_features_do_not_depend_on_the_batch():
    words = ["banana", "a", "été", "xy"]
    flat, n = features(words, {"a"})
    at = 0
    for w, k in zip(words, n):
        one, _ = features([w], {"a"})
        assert sorted(one) == sorted(flat[at : at + k])
        at += k


def test_chains_keep_every_word():
    text = "One two\n\n" + "w " * (2 * CHAIN + 3) + "\n3 x_y"
    got = chains(text)
    assert max(map(len, got)) == CHAIN and sum(map(len, got)) == 2 + 2 * CHAIN + 3 + 2


SYL = {"aa": ["la", "mo", "ti", "ru"], "bb": ["sch", "ung", "ber", "keit"], "cc": ["oux", "eau", "que", "tre"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_switches(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang := list(SYL)[i % 3], 60) + "\n" + text(rng, lang, 20), lang, "s") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = train(docs)
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(got[i].lang_pred == y and 0 < got[i].score <= 1 for i, _, y, _ in rows if got[i].held_out)
    mixed = spark.createDataFrame([(1, text(rng, "aa", 12) + " " + text(rng, "bb", 12))], "doc_id long, text string")
    lang = [r.lang for r in label_words(mixed, model).orderBy("word_no").collect()]
    assert lang[:10] == ["aa"] * 10 and lang[14:] == ["bb"] * 10
    assert identify(mixed, model).first().n_langs == 2


def test_odd_rows(spark):
    rows = [(1, None, "aa"), (2, "", "bb"), (3, "12 ² 3!", "aa"), (4, "lamo tiru", None), (None, "schung", "bb"), (5, "lamo", "aa"), (5, "lamo", "aa"), (6, "berkeit", "bb"), (8, "tiru " * 30000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, train(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[4].lang_pred == "aa" and by[None].held_out is False
    none = docs.limit(0)
    assert identify(none, train(none)).count() == 0
    assert {r.lang_pred for r in identify(docs, train(none)).collect()} == {"und"}
    assert fit([("lamo", "aa")], ["aa"]).labels == ["aa"]
