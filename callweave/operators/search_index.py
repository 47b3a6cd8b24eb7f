"""An index of three-letter runs for searches by LIKE: postings in buckets, kept up by batch, verified against the texts.

A folder of two tables: ``postings`` (gram, call_id) and ``grams`` (gram, n), both partitioned by batch
and by a hash of the gram, so that a search reads the buckets of its own grams only. A batch of calls is
written under its number; a batch that comes again replaces itself. Postings are never taken back: what
a call's texts held before only makes it a candidate, and every candidate is verified.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.components import cut
from callweave.operators.stats import search_calls

#: Buckets of grams, parts that one bucket is written in, and grams of a term that are looked up at most (the rarest).
BUCKETS, SALTS, LOOKED_UP = 32, 4, 4
#: Texts of a call, and of its segments, that a search looks at.
OF_CALL, OF_SEGMENT = ["filename", "summary"], ["text_zh", "text_sv"]


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; null and shorter texts have none."""

    def runs(c: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
        return F.when(F.size(c) >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # bound to a variable, a text is split once and not for each of its runs
    return F.get(F.transform(F.array(F.filter(F.split(F.lower(text), ""), lambda x: x != "")), runs), F.lit(0))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def add_to_index(folder: str, batch: int, calls: DataFrame, segments: DataFrame) -> None:
    """Writes the postings of a batch of calls, new or changed, and of all their segments."""
    texts = [calls.select(F.col("id").alias("call_id"), F.col(c).alias("text")) for c in OF_CALL if c in calls.columns]
    own = segments.join(calls.select(F.col("id").alias("call_id")), "call_id", "left_semi")
    texts += [own.select("call_id", F.col(c).alias("text")) for c in OF_SEGMENT if c in segments.columns]
    rows = reduce(DataFrame.unionByName, texts).where("text is not null").select("call_id", F.explode(grams(F.col("text"))).alias("gram"))
    rows = rows.withColumn("bucket", bucket(F.col("gram")))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("call_id"), F.lit(SALTS))).distinct().sortWithinPartitions("bucket", "gram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/batch={batch}")
    written = calls.sparkSession.read.schema("call_id long, gram string, bucket int").parquet(f"{folder}/postings/batch={batch}")
    counted = written.groupBy("gram").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("gram")))
    counted.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams/batch={batch}")


def grams_of_term(spark: SparkSession, term: str) -> list[str]:
    """What every text that LIKE finds must hold: the grams of a term's parts between %, _ and escaped characters."""
    parts = [p for p in re.split(r"\\.|[%_\\]", term, flags=re.S) if p]
    rows = spark.createDataFrame([(p,) for p in parts], "part string").select(F.explode(grams(F.col("part")))).distinct().collect()
    return sorted(r[0] for r in rows)


def candidates(spark: SparkSession, folder: str, term: str, looked_up: int = LOOKED_UP) -> DataFrame | None:
    """(call_id) of calls that hold the term's rarest grams; None if the term has no run of three letters.

    The rarest gram's list is read first, and narrowed by the others'.
    """
    wanted = grams_of_term(spark, term)
    if not wanted:
        return None
    read = lambda kind, schema: spark.read.schema(f"{schema}, bucket int, batch long").option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}")
    at = dict(spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", bucket(F.col("gram"))).collect())
    of = lambda df, some: df.where(F.col("bucket").isin(sorted({at[g] for g in some})) & F.col("gram").isin(some))
    n = dict(of(read("grams", "gram string, n long"), wanted).groupBy("gram").agg(F.sum("n")).collect())
    if len(n) < len(wanted):
        return spark.createDataFrame([], "call_id long")
    rarest = sorted(wanted, key=lambda g: (n[g], g))[:looked_up]
    lists = [of(read("postings", "call_id long, gram string"), [g]).select("call_id").distinct() for g in rarest]
    return reduce(lambda a, b: a.join(b, "call_id", "left_semi"), lists)


def search_indexed(folder: str, calls: DataFrame, segments: DataFrame, contacts: DataFrame, q: str, **filters) -> DataFrame:
    """search_calls with the candidates of the index only: the same page and total, as q has to be met by each call.

    A term without a run of three letters goes through all calls. Calls that aren't in any batch aren't found.
    """
    found = candidates(calls.sparkSession, folder, q)
    if found is not None:
        found = cut(found)
        calls = calls.join(found.withColumnRenamed("call_id", "id"), "id", "left_semi")
        segments = segments.join(found, "call_id", "left_semi")
    return search_calls(calls, segments, contacts, q=q, **filters)
