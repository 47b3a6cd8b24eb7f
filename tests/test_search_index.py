import random

from pyspark.sql import functions as F

from callweave.operators.search_index import add_to_index, candidates, grams, grams_of_term, search_indexed
from callweave.operators.stats import search_calls

CALL = "id long, filename string, summary string, contact_hint string, phone string, call_time timestamp, duration_sec double, status string, source_id long, dup_of long"
SEG = "call_id long, id long, idx int, who string, contact_id long, text_zh string, text_sv string"


def tables(spark, seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcÀé你好_% ") for _ in range(rng.randrange(9)))
    calls = [(i, f"F{word()}.wav", rng.choice([None, word()]), "h", None, None, 1.0, "analyzed", 1, None if i % 9 else i - 1) for i in range(n)]
    segs = [(i, i * 10 + k, k, rng.choice(["me", "other"]), rng.choice([None, 1]), rng.choice([None, word(), word().upper()]), rng.choice([None, word()])) for i in range(n) for k in range(3)]
    return spark.createDataFrame(calls, CALL), spark.createDataFrame(segs, SEG), spark.createDataFrame([(1, "Ann")], "id long, name string")


def ids(df):
    return sorted((r.id, r.contact, r.total) for r in df.collect())


def test_grams_of_terms(spark):
    assert grams_of_term(spark, "ABcd") == ["abc", "bcd"] and grams_of_term(spark, "a%b_cd") == [] and grams_of_term(spark, "x_bcd%") == ["bcd"]
    assert grams_of_term(spark, r"ab\%cde") == ["cde"] and grams_of_term(spark, "") == [] and grams_of_term(spark, "你好吗") == ["你好吗"]


def test_a_text_is_split_once(spark):
    texts = ["".join(random.Random(n).choice("abÀ你😀 ") for _ in range(n)) for n in (0, 2, 3, 400)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(grams(F.col("t")).alias("g"))
    assert [r.g for r in got.collect()] == [list(dict.fromkeys(t.lower()[i : i + 3] for i in range(len(t) - 2))) for t in texts] + [[]]
    # splitting it for each of its runs took time with the square of its length
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_indexed_search_equals_the_scan(spark, tmp_path):
    calls, segs, contacts = tables(spark)
    folder = str(tmp_path / "i")
    for batch in (0, 1, 0):  # one batch again
        add_to_index(folder, batch, calls.where(f"id % 2 = {batch}"), segs)
    # a later batch brings other texts for a call; what it had before is a candidate at most
    segs = segs.where("call_id <> 4").unionByName(spark.createDataFrame([(4, 400, 0, "me", None, "zzzq", None)], SEG))
    add_to_index(folder, 2, calls.where("id = 4"), segs)
    for q, kw in (("abc", {}), ("ÀÉ你", {}), ("zzz", {}), ("b", {}), ("a_c", {}), ("nothing", {}), ("cab", {"who": "me"}), ("bca", {"contact": "ann"}), (".WAV", {"dup": "only"}), ("f%wav", {"size": 7, "page": 2})):
        kw = {"size": 1000} | kw
        assert ids(search_indexed(folder, calls, segs, contacts, q, **kw)) == ids(search_calls(calls, segs, contacts, q=q, **kw)), q
    every = search_indexed(folder, calls, segs, contacts, "wav", size=None)
    assert every.count() == every.first().total > 25
    assert {r.call_id for r in candidates(spark, folder, "zzzq").collect()} == {4} and candidates(spark, folder, "a%") is None


def test_no_calls(spark, tmp_path):
    calls, segs, contacts = tables(spark)
    add_to_index(str(tmp_path / "i"), 0, calls.limit(0), segs)
    assert candidates(spark, str(tmp_path / "i"), "abc").count() == 0
