"""Cutting lineage, groups of any size without a hot task, and connected components of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to where they meet a value of their key.
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages, which all executors share.

    The session's ``spark.checkpoint.dir``. Only on one machine, as in tests, is a temporary one made
    where that is unset; a cluster without one is an error, as its executors couldn't read each
    other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="callweave-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read back, so that plans start there."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_group(rows: DataFrame, by: list[str], salt: Column, then: Callable[[DataFrame], DataFrame] | None = None, **aggregates: Column) -> DataFrame:
    """rows with aggregates over all rows of their values of ``by``, which must not be null.

    The aggregates are combined before the shuffle, and ``then`` may filter or widen their table.
    Each group's result goes only to the salts that the group's rows have, so that a hot group is
    dealt over up to SALTS tasks, and no group costs more rows than it holds.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt")))
    found = salted.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()], mask.alias("_mask"))
    found = then(found) if then else found
    has = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("shiftright", F.col("_mask"), i).bitwiseAND(F.lit(1)) == 1)
    found = found.withColumn("_salt", F.explode(has)).drop("_mask")
    return salted.join(found, [*by, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches.

    Alternates two local steps until nothing changes: every node links its larger neighbours to
    its smallest one, then its smaller ones (itself included) to the smallest. Each round is two
    pre-aggregated minima that meet their node's edges over salts, so that a hub isn't one task;
    lineage is cut each round. Rows with a null end and loops are ignored; a node without edges
    isn't returned.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # equal edge sets have equal counts and hashes
    sign = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = sign(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, ["u"], F.col("v"), low=F.min("v")).where("v > u")
        large = cut(large.select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct())
        small = (
            with_group(large, ["u"], F.col("v"), m=F.min("v"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = sign(e)
        if now == seen:
            break
        seen = now
    low = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().join(low, "node", "left_anti").select("node", F.col("node").alias("component"))
    return low.union(roots)
