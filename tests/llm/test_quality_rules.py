import random
import re

import numpy as np

from callweave.llm.quality_rules import apply_rules, keep_rows, measure, platt, repeated, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n \n", "a\n\na\n a\na", "x y z x y z", "é b c\x0bd\x1ce", "# $a |\r\n# $a |\r\n"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "#", "ab ", "é"]) for _ in range(rng.randrange(150))) for _ in range(100)]
    for t in texts:
        m = measure(t)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == slow(t), repr(t)


def test_many_distinct_words_do_not_overflow():
    seq = np.r_[np.arange(3_000_000), np.arange(5)]
    assert repeated(seq, 3_000_000) == 10


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(w if good else w.upper() + rng.choice(["!!", "##", " |"]) for w in words), i))
        labels.append((i, int(good)))
    return rows, labels


def test_classifier_separates_and_is_calibrated(spark):
    rows, labels = corpus(240, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    fresh, truth = corpus(150, 2)
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame(fresh, "doc_id long, text string, kept long"), model).collect()}
    assert sum(got[i].kept == bool(y) for i, y in truth) >= 148
    assert all(0 <= r.quality <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "w " * 200_000), (None, " ".join(map(str, range(60))))], "doc_id long, text string")
    for labels in ([], [(1, None), (3, 1), (None, 0), (77, 1), (2, 5)]):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = {r.doc_id: r for r in apply_rules(docs, model).collect()}
        assert len(got) == 4 and got[1].base_failed and got[2].n_words == 0 and got[3].base_failed and got[3].n_repeat_words == 200_000
        assert got[None].kept
    assert apply_rules(docs.limit(0), model).count() == 0


def test_repeated_keys_give_one_model(spark):
    rows, labels = corpus(90, 4)
    again = [(i, t.upper(), k) for i, t, k in rows[:40]]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    made = [train(spark.createDataFrame(r, "doc_id long, text string, kept long").repartition(n), marks) for r, n in ((rows + again, 1), (again + rows, 5))]
    assert made[0].bias == made[1].bias and (made[0].words == made[1].words).all() and (made[0].chars == made[1].chars).all()


def test_platt_recovers_a_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000) * 3
    y = (rng.random(20000) < 1 / (1 + np.exp(-(0.7 * x - 0.4)))).astype(float)
    a, b = platt(x, y)
    assert abs(a - 0.7) < 0.05 and abs(b + 0.4) < 0.08


def test_kept_rows_are_those_that_the_rules_keep(spark):
    rows, labels = corpus(120, 3)
    docs = spark.createDataFrame([*rows, (500, None, 1), (501, "a b", None)], "doc_id long, text string, kept long")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    want = {r.doc_id for r in apply_rules(docs, model).where("kept").collect()}
    got = keep_rows(docs, model)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want and want
