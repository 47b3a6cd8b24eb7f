import numpy as np
from pyspark.sql import functions as F

from callweave.functions.vectors import means, sums, unit


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_vector_and_its_length_are_taken_once(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").select(unit(F.transform("v", lambda x: x + 0.5)).alias("u"))
    got = [r.u for r in df.collect()]
    for r, u in zip(rows[:3], got):
        v = np.array(r) + 0.5
        assert np.allclose(u, v / (np.linalg.norm(v) + 1e-9))
    assert got[3] is None
    # the length was worked out, and the vector made, for each element
    assert plan(df).count("0.5") == 1 and plan(df).count("SQRT") == 1


def test_sums_of_many_small_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 7 if i % 7 else None, str(i % 3), None if i % 11 == 0 else rng.normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b string, embedding array<double>").repartition(5)
    want = {}
    for a, b, v in rows:
        if v:
            want.setdefault((a, b), []).append(v)
    found = sums(df, ["a", "b"])
    got = {(r.a, r.b): (r.total, r.n) for r in found.collect()}
    assert set(got) == set(want)
    for k, vs in want.items():
        assert got[k][1] == len(vs) and np.allclose(got[k][0], np.sum(vs, 0))
    mean = {(r.a, r.b): r["mean"] for r in means(df, ["a", "b"]).collect()}
    assert all(abs(np.linalg.norm(m) - 1) < 1e-6 for m in mean.values())
    # a call of Python for each group took most of the time
    assert "FlatMapGroups" not in plan(found)
