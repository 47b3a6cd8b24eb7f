"""A sink of listings that is safe against replay: a ledger of batches, and the last state of each file.

A folder of tables: ``changes/batch=N`` has the files that batch N added or changed, a mark in
``ledger/batch=N`` says that this is whole; ``state/batch=N`` has the last state of each file up to
batch N, and ``compacted/batch=N`` says that it is whole. A batch
in the ledger does nothing when it comes again. A batch that broke off before its entry in the ledger
comes again as well: its folder is overwritten with the same rows, since all that it reads are entries
of the ledger. State is the newest compacted table and the changes after it, so that a batch costs what
it changes; it is compacted every so many batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "path string, length long, modificationTime timestamp, action string"
STATE = "path string, length long, modificationTime timestamp"
#: What a mark holds: how many files the batch added and changed.
MARK = "added long, updated long"


class FileLedger:
    """What batches of listings have changed, kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 20, then: Callable[[DataFrame, int], None] | None = None):
        """``then`` gets a batch's changes before it is entered, and again if it breaks off: let it overwrite what it writes by batch."""
        self.spark, self.folder, self.compact_every, self.then = spark, folder.rstrip("/"), compact_every, then

    def _numbers(self, kind: str) -> set[int]:
        """The batches that one of the folders of marks names."""
        try:
            marks = self.spark.read.schema(f"{MARK}, batch long").option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return set()
            raise
        return {r.batch for r in marks.select("batch").distinct().collect()}

    def _mark(self, kind: str, batch: int, changes: DataFrame) -> None:
        one = changes.agg(F.count_if(F.col("action") == "added").alias("added"), F.count_if(F.col("action") == "updated").alias("updated"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def batches(self) -> list[int]:
        return sorted(self._numbers("ledger"))

    def _read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={n}" for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{kind}").parquet(*paths)
        return rows.select(*[f.name for f in rows.schema if f.name != "batch"], F.col("batch").cast("long").alias("batch"))

    def changes(self, below: int | None = None) -> DataFrame:
        """(path, length, modificationTime, action, batch) of all batches, or of those before one."""
        return self._read("changes", [n for n in self.batches() if below is None or n < below], CHANGE)

    def state(self, below: int | None = None) -> DataFrame:
        """(path, length, modificationTime): each file as it was last seen."""
        known = [n for n in self.batches() if below is None or n < below]
        bases = [n for n in self._numbers("compacted") if n in known]
        base = max(bases, default=-1)
        cols = [f.split()[0] for f in STATE.split(", ")]
        rows = self._read("state", [base] if bases else [], STATE).select(*cols, "batch").unionByName(self._read("changes", [n for n in known if n > base], CHANGE).select(*cols, "batch"))
        return rows.groupBy("path").agg(F.max_by(F.struct(*cols[1:]), "batch").alias("s")).select("path", "s.*")

    def __call__(self, listing: DataFrame, batch: int) -> None:
        """Takes in a listing (path, length, modificationTime). Of rows of one path the latest counts; files that aren't listed keep their state."""
        if batch in self._numbers("ledger"):
            return
        last = F.max_by(F.struct("length", "modificationTime"), F.struct("modificationTime", "length"))
        new = listing.where("path is not null").groupBy("path").agg(last.alias("n")).select("path", "n.length", "n.modificationTime")
        old = self.state(batch).select("path", F.col("length").alias("_l"), F.col("modificationTime").alias("_t"), F.lit(True).alias("_old"))
        met = new.join(old, "path", "left").where(F.col("_old").isNull() | ~F.col("length").eqNullSafe(F.col("_l")) | ~F.col("modificationTime").eqNullSafe(F.col("_t")))
        fresh = met.withColumn("action", F.when(F.col("_old").isNull(), "added").otherwise("updated")).select("path", "length", "modificationTime", "action")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")
        written = self.spark.read.schema(CHANGE).parquet(f"{self.folder}/changes/batch={batch}")
        if self.then:
            self.then(written, batch)
        self._mark("ledger", batch, written)
        if len(self.batches()) % self.compact_every == 0:
            self.state(batch + 1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
            self._mark("compacted", batch, written)
