"""Listing of recordings, incremental scans, fingerprints, and JSON lines in and out."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.components import cut
from callweave.functions.text import parse_filename
from callweave.operators.stats import done, live

#: Suffixes of recordings, and bytes at either end of a file that its fingerprint is taken of.
SLICE = 65536
EXTENSIONS = [".m4a", ".mp3", ".wav", ".amr", ".ogg", ".opus", ".flac", ".aac", ".mp4", ".3gp"]
FILE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
REFINED = "call_id long, seg_id long, attempt long, text string, lang string, words array<struct<w:string,s:long,e:long>>, error string, _corrupt_record string"


def wanted(path: F.Column, extensions: list[str], exclude_dirs: list[str]) -> F.Column:
    """Whether a file has one of the suffixes and no folder that is excluded or starts with . or ~."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda d: F.lower(d).isin(*[x.lower() for x in exclude_dirs]) | d.startswith(".") | d.startswith("~")) if exclude_dirs else F.exists(folders, lambda d: d.startswith(".") | d.startswith("~"))
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*[x.lower() for x in extensions]) & ~bad


def list_recordings(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, exclude_dirs: list[str] = ()) -> DataFrame:
    """(path, length, modificationTime), by path. Spark itself hides empty files and names that start with _ or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", "^[a-z]+:/+", "/")
    inside = F.substring_index(below, root.rstrip("/"), -1) if root else below
    return files.where(wanted(inside, extensions, list(exclude_dirs))).orderBy("path")


def incremental_scan(listing: DataFrame, calls: DataFrame, source_id: int | None = None) -> DataFrame:
    """The calls after a scan, with action: unchanged, updated (size changed: pending again) or added; missing files keep their rows."""
    new = listing.select(F.col("path").alias("npath"), F.col("length").alias("nsize"), F.col("modificationTime").alias("mtime"))
    rows = calls.join(new, calls["path"] == new["npath"], "full_outer")
    added, seen = F.col("path").isNull(), F.col("npath").isNotNull()
    same = F.col("size_bytes").eqNullSafe(F.col("nsize"))
    action = F.when(added, "added").when(~seen, "missing").when(same, "unchanged").otherwise("updated")
    src = F.lit(source_id).cast(calls.schema["source_id"].dataType)
    rows = rows.withColumn("action", action)
    fresh = F.col("action").isin("added", "updated")
    cols = {
        "path": F.coalesce("path", "npath"),
        "size_bytes": F.when(fresh, F.col("nsize")).otherwise(F.col("size_bytes")),
        "status": F.when(fresh, "pending").otherwise(F.col("status")),
        "source_id": F.when(fresh, F.coalesce(src, F.col("source_id"))).otherwise(F.col("source_id")),
    }
    if "error" in calls.columns:
        cols["error"] = F.when(~fresh, F.col("error"))
    return rows.withColumns(cols).drop("npath", "nsize")


def scan_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("action").agg(F.count("*").alias("n"))


def refresh_hints(calls: DataFrame, patterns: list[str] | None = None, local: bool = True) -> DataFrame:
    """calls with name, number and time parsed anew where that gives something, and hints_changed."""
    got = parse_filename(F.col("filename"), None, patterns, local)
    rows = calls.withColumn("_got", got)
    new = {"contact_hint": F.coalesce("_got.name", "contact_hint"), "phone": F.coalesce("_got.phone", "phone"), "call_time": F.coalesce("_got.call_time", "call_time")}
    changed = F.lit(False)
    for c, x in new.items():
        changed = changed | ~x.eqNullSafe(F.col(c))
    return rows.withColumn("hints_changed", changed).withColumns(new).drop("_got")


def wav_seconds(content: F.Column) -> F.Column:
    """Seconds of a plain PCM wav from the bytes of its header, or null."""
    number = lambda at: F.conv(F.hex(F.concat(*[F.substring(content, at + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("double")
    is_wav = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645") & (F.hex(F.substring(content, 37, 4)) == "64617461")
    return F.when(is_wav & (number(29) > 0), number(41) / number(29))


def backfill_duration(calls: DataFrame, probes: DataFrame) -> DataFrame:
    p = probes.where("seconds is not null").select(F.col("path").alias("ppath"), "seconds")
    return calls.join(p, calls["path"] == p["ppath"], "left").withColumn("duration_sec", F.coalesce("duration_sec", "seconds")).drop("ppath", "seconds")


def sampled_fingerprint(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, probe_key) of candidate files: a digest of size, head and (beyond two slices) tail."""
    rows = files.join(candidates.select("path").distinct(), "path", "left_semi")
    tail = F.when(F.col("length") > 2 * SLICE, F.substring(F.col("content"), -SLICE, SLICE)).otherwise(F.lit(b""))
    return rows.select("path", F.sha2(F.concat(F.col("length").cast("string").cast("binary"), F.substring(F.col("content"), 1, SLICE), tail), 256).alias("probe_key"))


def read_slices(uri: str, length: int) -> bytes | None:
    """What a file's fingerprint is taken of: its size, its head and (beyond two slices) its tail; null if it can't be read.

    Only those bytes are read, from any store that has a scheme, or from a path that all machines see.
    """
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
        with store.open_input_file(path) as f:
            head = f.read(SLICE)
            tail = b""
            if length > 2 * SLICE:
                f.seek(length - SLICE)
                tail = f.read(SLICE)
        return str(length).encode() + head + tail
    except OSError:
        return None


def probe_files(listing: DataFrame, at_once: int = 64) -> DataFrame:
    """(path, length, modificationTime, probe_key) of listed files, by byte ranges, in parallel; null keys of unreadable ones."""
    sha = hashlib.sha256

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                rows = batch.slice(i, at_once)
                found = [None if p is None or n is None else read_slices(p, n) for p, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([None if b is None else sha(b).hexdigest() for b in found], pa.string())], ["path", "length", "modificationTime", "probe_key"])

    rows = listing.select("path", "length", "modificationTime")
    return rows.mapInArrow(run, "path string, length long, modificationTime timestamp, probe_key string")


def ensure_probes(listing: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Fingerprints of all listed files, from a table of those computed so far, and how many files were read now.

    A key holds for a path, size and time, so that a file that is recorded again is read again. Files
    that can't be read have no key and are tried again the next time. New keys are appended; of
    repeated ones, as after a batch that broke off, any counts, as they are equal.
    """
    spark = listing.sparkSession
    schema = "path string, length long, modificationTime timestamp, probe_key string"
    try:
        known = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    asked = listing.where("path is not null").select("path", "length", "modificationTime").distinct()
    keys = ["path", "length", "modificationTime"]
    a, b = asked.alias("a"), known.select(*keys).alias("b")
    same = (F.col("a.path") == F.col("b.path")) & F.col("a.length").eqNullSafe(F.col("b.length")) & F.col("a.modificationTime").eqNullSafe(F.col("b.modificationTime"))
    missing = cut(a.join(b, same, "left_anti"))
    n = missing.count()
    if n:
        cores = spark.sparkContext.defaultParallelism
        cut(probe_files(missing.repartition(max(cores, -(-n // 1000)))).where("probe_key is not null")).write.mode("append").parquet(folder)
    every = spark.read.schema(schema).parquet(folder) if n or known.columns and not known.isEmpty() else known
    keyed = every.groupBy(*keys).agg(F.min("probe_key").alias("probe_key")).alias("b")
    return a.join(keyed, same).select("a.path", "a.length", "a.modificationTime", "b.probe_key"), n


def refine_jobs(calls: DataFrame, segments: DataFrame, outputs: DataFrame, engine: str = "qwen3-asr") -> DataFrame:
    """(call_id, seg_id, wav, start_ms, end_ms, context): a row for each segment of calls without the engine's output."""
    have = outputs.where(F.col("engine") == engine).select(F.col("call_id").alias("id"))
    rows = live(calls).where(done() & F.col("wav_path").isNotNull()).join(have, "id", "left_anti")
    context = F.substring(F.trim(F.concat_ws(" ", "contact_hint", "phone")), 1, 80)
    rows = rows.select(F.col("id").alias("call_id"), F.col("wav_path").alias("wav"), context.alias("context"))
    return segments.select("call_id", F.col("id").alias("seg_id"), "start_ms", "end_ms").join(rows, "call_id").select("call_id", "seg_id", "wav", "start_ms", "end_ms", "context")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_refine_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results (lines that don't parse left out), and one row of counts: read, broken, with errors."""
    rows = spark.read.schema(REFINED).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    ok = rows.where("_corrupt_record is null and seg_id is not null").drop("_corrupt_record")
    lines = spark.read.text(path).agg(F.count("*").alias("read"))
    return ok, lines.join(ok.agg(F.count("*").alias("parsed"), F.count("error").alias("errors"))).select("read", (F.col("read") - F.col("parsed")).alias("broken"), "errors")


def assign_source(calls: DataFrame, source_id: int, counts: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls without a source get this one; the source's row records the counts of the scan."""
    n = counts.groupBy().pivot("action", ["added", "updated", "unchanged"]).agg(F.sum("n"))
    n = n.select(F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "updated", "unchanged")]).alias("last_result"))
    out = sources.join(n).withColumn("last_result", F.when(F.col("id") == source_id, F.col("last_result")))
    return calls.withColumn("source_id", F.coalesce("source_id", F.lit(source_id).cast(calls.schema["source_id"].dataType))), out

