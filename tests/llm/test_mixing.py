import math
import random
import struct

import pytest
import xxhash

from callweave.llm import mixing
from callweave.llm.mixing import exponent, mix


def h(seed, *longs):
    for v in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def entropy(w):
    return -sum(x * math.log(x) for x in w)


def weights(p, a):
    w = [x**a for x in p]
    return [x / sum(w) for x in w]


def sources(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")


def test_exponent_meets_the_entropy(spark):
    tokens = [1000, 300, 40, 7]
    p = [t / sum(tokens) for t in tokens]
    goal = (entropy(p) + math.log(4)) / 2
    a = exponent(sources(spark, [*tokens, 0]), entropy=goal, max_repeats=None)
    assert abs(entropy(weights(p, a)) - goal) < 1e-6
    assert exponent(sources(spark, tokens), entropy=9, max_repeats=None) == 0 and exponent(sources(spark, tokens), entropy=0.01, max_repeats=None) == 1


def test_exponent_meets_the_repeats(spark):
    tokens = [1000, 300, 40]
    a = exponent(sources(spark, tokens), max_repeats=3)
    assert abs((1000 / 40) ** (1 - a) - 3) < 1e-5
    a = exponent(sources(spark, tokens), max_repeats=3, budget=1340)
    w = weights([t / 1340 for t in tokens], a)
    assert abs(max(x * 1340 / t for x, t in zip(w, tokens)) - 3) < 1e-5


def corpus():
    rng = random.Random(4)
    return [(i, "w " * rng.randrange(1, 30), rng.choice(["big"] * 12 + ["mid"] * 3 + ["low", None])) for i in range(500)]


def slow(docs, a, pay, blocks, seed=17):
    """(doc_id, epoch) of every reading."""
    out, tokens, block = [], {}, {}
    for i, t, s in docs:
        tokens[s] = tokens.get(s, 0) + len(t.split())
        block.setdefault(s, {}).setdefault(h(42, i) % blocks, []).append((i, len(t.split())))
    norm = sum(t**a for t in tokens.values())
    for s, t in tokens.items():
        due = pay(norm, max(tokens.values())) * t**a / norm
        epochs = int(due / t + 1e-9)
        rest = due - epochs * t
        order = sorted(block[s], key=lambda b: hash_place(seed, epochs, b))
        sofar, chosen = 0, []
        for b in order:
            sofar += sum(n for _, n in block[s][b])
            if sofar > rest + 1e-6:
                break
            chosen.append(b)
        for b, rows in block[s].items():
            out += [(i, e) for i, _ in rows for e in range(epochs + (b in chosen))]
    return sorted(out)


def hash_place(seed, epoch, b):
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)  # an int literal
    # Spark hashes a 32-bit integer as four bytes
    return h(first, epoch, b)


@pytest.mark.parametrize("few", [10_000, 0])
def test_readings_equal_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    tokens = {}
    for _, t, s in docs:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    a = exponent(spark.createDataFrame([(s, t) for s, t in tokens.items()], "source string, tokens long"), max_repeats=2.5)
    got = sorted((r.doc_id, r.epoch) for r in mix(df, max_repeats=2.5, blocks=64).select("doc_id", "epoch").collect())
    assert got == slow(docs, a, lambda norm, most: most ** (1 - a) * norm, 64)
    assert {i for i, _ in got} == {i for i, _, _ in docs}
    a = exponent(spark.createDataFrame([(s, t) for s, t in tokens.items()], "source string, tokens long"), max_repeats=2.5, budget=3000.0)
    got = sorted((r.doc_id, r.epoch) for r in mix(df, max_repeats=2.5, budget=3000.0, blocks=64).collect())
    assert got == slow(docs, a, lambda norm, most: 3000.0, 64)


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, "x y", "b", 3), (3, "x y", "b", 3), (None, "z", "b", 4), (5, "q " * 40000, "c", 5)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")).collect()
    assert {(r.doc_id, r.source) for r in got} == {(r[0], r[2]) for r in rows}
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
