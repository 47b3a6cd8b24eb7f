import itertools
import random
import re

from callweave.llm.filter_audit import COUNTS, audit_filters, document_masks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The letters that each (key, text, part) row fails, by the rules as they are stated."""
    out = []
    for key, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t))]
        bad.append(key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in rows))
        out.append({c for c, b in zip("ABCDE", bad) if b})
    return out


def slow(rows, labels):
    failing, out = fails(rows), {}
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    for part in {p or "" for _, _, p in rows}:
        own = [(k, f) for (k, _, p), f in zip(rows, failing) if (p or "") == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for step, c in enumerate(order, 1):
                here = [x for x in left if c in x[1]]
                redundant = sum(c in f for _, f in gone)
                left = [x for x in left if c not in x[1]]
                gone += here
                lost[c] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(f == {c} for _, f in own), sum(k in good for k, _ in here), sum(k in toxic for k, _ in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(lost[order[step - 1]])
    return out


def fixture(n=160, seed=4):
    rng = random.Random(seed)
    rows = [(900, None, "en"), (901, "", None), (902, "", "en"), (None, "", "en"), (902, "", "en"), (903, " \t\n", ""), (904, "é" * 50 + " A", "fr"), (905, "x " * 30_000, "fr"), (906, "\x1c \x85 \xa0", "fr")]
    for i in range(n):
        words = [rng.choice(["ab", "Ab", "c#", "|", "x\x0by", "ü"]) if rng.random() < 0.2 else f"w{rng.randrange(rng.choice([30, 900]))}" for _ in range(rng.choice([5, 199, 200, 260]))]
        rows.append((i, rng.choice([" ", "\n"]).join(words), rng.choice(["en", "de", None])))
    rows += [(300 + i, rng.choice(rows)[1], rng.choice(["en", "de"])) for i in range(80)] + rows[20:24]
    labels = [(rng.choice([None, *range(400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, mask string, count long")
    return docs, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_audit_equals_applying_every_order(spark):
    rows, labels = fixture()
    docs, marks = frames(spark, rows, labels)
    got = {(r.part, r.filter_order, r.step): [*(r[c] for c in COUNTS), r.shapley] for r in audit_filters(docs, marks).collect()}
    assert got == slow(rows, labels) and len(got) == 600 * 4


def test_masks_of_odd_rows(spark):
    rows, _ = fixture(10)
    docs, _ = frames(spark, rows, [])
    bits = lambda f: sum(1 << "ABCDE".index(c) for c in f)
    assert sorted((r.key or -1, r.mask) for r in document_masks(docs).collect()) == sorted((k or -1, bits(f)) for (k, _, _), f in zip(rows, fails(rows)))


def test_no_rows(spark):
    docs, marks = frames(spark, *fixture(3))
    assert audit_filters(docs.limit(0), marks).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in audit_filters(docs, marks.limit(0)).collect()} == {(0, 0)}
