"""Assembly of transcripts and audits of the seams between chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.components import cut
from callweave.functions.text import strip_tags

STEP, MIN_CHUNK = 20_000, 400


def merge_intervals(rows: DataFrame, min_ms: int = 500, gap_ms: int = 350) -> DataFrame:
    """(call_id, start_ms, end_ms): short intervals dropped, those less than gap_ms apart joined."""
    kept = rows.where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    w = Window.partitionBy("call_id").orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_ms") - before >= gap_ms), 1).otherwise(0)
    island = kept.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("call_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def embeddable(segments: DataFrame, min_ms: int = 1500) -> DataFrame:
    return segments.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def split_chunks(segments: DataFrame, step_ms: int = STEP) -> DataFrame:
    """(call_id, seg_id, chunk_no, start_ms, end_ms): pieces of at most step_ms; none is empty."""
    end = F.greatest("end_ms", F.col("start_ms") + MIN_CHUNK)
    rows = segments.select("call_id", F.col("id").alias("seg_id"), end.alias("stop"), F.posexplode(F.sequence(F.col("start_ms"), end - 1, F.lit(step_ms).cast("long"))).alias("chunk_no", "start_ms"))
    return rows.select("call_id", "seg_id", "chunk_no", "start_ms", F.least(F.col("start_ms") + step_ms, "stop").alias("end_ms"))


def pack_batches(chunks: DataFrame, items: int = 4, piece: int = 200_000) -> DataFrame:
    """(seg_id, n_chunks, batch): all segments in order of call and segment, batches of up to items chunks.

    A segment isn't divided; one with more chunks than fit stands alone. One order, in parallel: a run
    of segments is a function from the chunks that the open batch holds (0 to items) to those that it
    holds after the run and the batches closed on the way. Runs of about ``piece`` segments are
    measured at once, the functions are composed, and each run is numbered from where it begins.
    """
    rows = chunks.groupBy("call_id", "seg_id").agg(F.count("*").alias("n_chunks"))
    parts = max(1, -(-rows.count() // piece))
    runs = cut(rows.repartitionByRange(parts, "call_id", "seg_id").withColumn("run", F.spark_partition_id()))

    def through(sizes, held: int) -> tuple[list[int], int]:
        """The batch of each segment, from 0, and what is held in the end."""
        out, batch = [], 0
        for n in sizes:
            if held and held + n > items:
                batch, held = batch + 1, 0
            held = min(held + n, items)
            out.append(batch)
        return out, held

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(["call_id", "seg_id"])["n_chunks"].tolist()
        ends = [through(sizes, held) for held in range(items + 1)]
        return pd.DataFrame({"run": int(pdf["run"].iloc[0]), "begins": range(items + 1), "ends": [h for _, h in ends], "closed": [o[-1] for o, _ in ends]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        held, batch, out = 0, 0, []
        for run, own in pdf.sort_values("run").groupby("run"):
            out.append((run, held, batch))
            r = own[own["begins"] == held].iloc[0]
            held, batch = int(r["ends"]), batch + int(r["closed"])
        return pd.DataFrame(out, columns=["run", "held", "first"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["call_id", "seg_id"])
        out, _ = through(pdf["n_chunks"].tolist(), int(pdf["held"].iloc[0]))
        return pdf.assign(batch=np.array(out) + pdf["first"])[["seg_id", "n_chunks", "batch"]]

    # items + 1 rows a run
    starts = runs.groupBy("run").applyInPandas(measure, "run int, begins int, ends int, closed long").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(compose, "run int, held int, first long")
    return runs.join(F.broadcast(cut(starts)), "run").groupBy("run").applyInPandas(number, "seg_id long, n_chunks long, batch long")


def stitch_chunks(results: DataFrame) -> DataFrame:
    """(seg_id, text, lang, words, blocks, empty_blocks) from (seg_id, chunk_no, start_ms, text, lang, words)."""
    word = lambda off: lambda w: F.struct(w["w"].alias("w"), (w["s"] + off).alias("s"), (w["e"] + off).alias("e"))
    moved = F.transform(F.coalesce("words", F.array().cast("array<struct<w:string,s:bigint,e:bigint>>")), word(F.col("start_ms")))
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = results.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", text.alias("text"), F.nullif(F.col("lang"), F.lit("")).alias("lang"), moved.alias("words")))).alias("l"))
    texts = F.filter(F.col("l.text"), lambda t: t != "")
    return rows.select("seg_id", F.array_join(texts, "").alias("text"), F.get(F.filter(F.col("l.lang"), lambda x: x.isNotNull()), F.lit(0)).alias("lang"), F.flatten(F.col("l.words")).alias("words"), F.size("l").alias("blocks"), (F.size("l") - F.size(texts)).alias("empty_blocks"))


def latest_complete(results: DataFrame, segments: DataFrame) -> DataFrame:
    """The last result (by attempt) of each segment, of calls whose segments all have one without error."""
    last = results.groupBy("call_id", "seg_id").agg(F.max_by(F.struct("attempt", "text", "lang", "words", "error"), "attempt").alias("r")).select("call_id", "seg_id", "r.*").where("error is null")
    have = last.groupBy("call_id").agg(F.count("*").alias("have"))
    want = segments.groupBy("call_id").agg(F.count("*").alias("want"))
    return last.join(want.join(have, "call_id").where("have = want"), "call_id", "left_semi")


def fold_refined(segments: DataFrame, results: DataFrame, aligner: str = "qwen3-aligner") -> DataFrame:
    """segments with refined text: the first text is kept in text_sv; words set start, end, source and confidence.

    Only what a result has is changed: one without text leaves the texts, one without words the times,
    and segments without a result stay as they are.
    """
    r = results.select(F.col("seg_id").alias("rid"), F.nullif(F.col("text"), F.lit("")).alias("new"), "words")
    rows = segments.join(r, segments["id"] == r["rid"], "left")
    old = lambda c, kind: F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    told, timed = F.col("new").isNotNull(), F.size(F.coalesce("words", F.array())) > 0
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    return rows.withColumns({
        "text_sv": F.when(told, F.coalesce(old("text_sv", "string"), F.col("text_zh"))).otherwise(old("text_sv", "string")),
        "text_zh": F.coalesce("new", "text_zh"),
        "start_ms": F.when(timed, first["s"]).otherwise(F.col("start_ms")),
        "end_ms": F.when(timed, last["e"]).otherwise(F.col("end_ms")),
        "align_source": F.when(timed, F.lit(aligner)).otherwise(old("align_source", "string")),
        "ts_confidence": F.when(timed, F.lit(0.9)).otherwise(old("ts_confidence", "double")),
    }).drop("rid", "new", "words")


def outputs_of(results: DataFrame, engine: str = "qwen3-asr") -> DataFrame:
    """(call_id, engine, attempt, lang, text, words) of results: texts joined by blanks, in order of segment."""
    word = "array<struct<w:string,s:bigint,e:bigint>>"
    rows = results.groupBy("call_id").agg(F.max("attempt").alias("attempt"), F.sort_array(F.collect_list(F.struct("seg_id", "lang", "text", F.coalesce("words", F.array().cast(word)).alias("words")))).alias("l"))
    texts = F.filter(F.col("l.text"), lambda t: t.isNotNull() & (t != ""))
    return rows.select("call_id", F.lit(engine).alias("engine"), "attempt", F.coalesce(F.get(F.col("l.lang"), F.lit(0)), F.lit("")).alias("lang"), F.array_join(texts, " ").alias("text"), F.flatten(F.col("l.words")).alias("words"))


def upsert_outputs(outputs: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each call and engine: the one of the last attempt; of equal ones the new one."""
    both = outputs.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in new.columns if c not in ("call_id", "engine")]
    return both.groupBy("call_id", "engine").agg(F.max_by(F.struct(*rest), F.struct("attempt", "_new")).alias("_r")).select(*[F.col(f"_r.{c}") if c in rest else c for c in new.columns])


def merge_outputs(folder: str, new: DataFrame, buckets: int = 256) -> DataFrame:
    """Upserts rows into a table of outputs in a folder that executors share, and returns the table.

    The table is partitioned by a hash of the call. The buckets that the batch touches are read, merged
    and overwritten; all others stay as they are. A batch that is replayed, whole or after breaking off,
    gives the same table, as the last attempt wins.
    """
    spark = new.sparkSession
    own = cut(new.withColumn("bucket", F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int")))
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]
    read = lambda: spark.read.schema(own.schema).parquet(folder)
    try:
        old = read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], own.schema)
    # written apart first: a table can't be overwritten while it is read
    merged = cut(upsert_outputs(old.where(F.col("bucket").isin(touched)), own))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return read().drop("bucket")


def rebuild_fulltext(calls: DataFrame, segments: DataFrame, results: DataFrame) -> DataFrame:
    """calls where those of the results have fulltext_zh made anew of their segments' texts, in order."""
    own = results.select("call_id").distinct()
    rows = segments.join(own, "call_id", "left_semi").where("text_zh is not null").groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "text_zh"))).alias("l"))
    text = own.join(rows, "call_id", "left").select(F.col("call_id").alias("_call"), F.coalesce(F.array_join(F.col("l.text_zh"), " "), F.lit("")).alias("_text"))
    old = F.col("fulltext_zh") if "fulltext_zh" in calls.columns else F.lit(None).cast("string")
    return calls.join(text, calls["id"] == text["_call"], "left").withColumn("fulltext_zh", F.coalesce("_text", old)).drop("_call", "_text")


def seam_counts(segments: DataFrame, step_ms: int = STEP) -> DataFrame:
    n = split_chunks(segments, step_ms).groupBy("seg_id").agg(F.count("*").alias("n"))
    longest = segments.agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    return n.agg(F.count("*").alias("segments"), F.count_if(F.col("n") > 1).alias("split_segments"), F.sum(F.col("n") - 1).alias("seams")).join(longest)


def word_gaps(words: DataFrame) -> DataFrame:
    """(call_id, prev_e, next_s, gap_ms) between consecutive words of a call by start; negatives dropped."""
    w = Window.partitionBy("call_id").orderBy("s", "e")
    rows = words.select("call_id", F.col("e").alias("prev_e"), F.lead("s").over(w).alias("next_s"))
    return rows.where("next_s >= prev_e").withColumn("gap_ms", F.col("next_s") - F.col("prev_e"))


def seams(segments: DataFrame, step_ms: int = STEP) -> DataFrame:
    return split_chunks(segments, step_ms).where("chunk_no > 0").select("call_id", F.col("start_ms").alias("seam_ms"))


def seam_hits(gaps: DataFrame, seam_rows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """gaps with the lowest seam inside them, if any: a range join on call and minute of the seam."""
    minutes = F.sequence(F.floor(F.col("prev_e") / bucket_ms), F.floor(F.col("next_s") / bucket_ms))
    g = gaps.withColumn("bucket", F.explode(minutes))
    s = seam_rows.withColumn("bucket", F.floor(F.col("seam_ms") / bucket_ms)).withColumnRenamed("call_id", "cid")
    hit = g.join(s, (g["call_id"] == s["cid"]) & (g["bucket"] == s["bucket"]) & F.col("seam_ms").between(F.col("prev_e"), F.col("next_s")))
    return hit.groupBy("call_id", "prev_e", "next_s", "gap_ms").agg(F.min("seam_ms").alias("seam_ms"))


def seam_risk(gaps: DataFrame, hits: DataFrame, gap_ms: int = 600) -> DataFrame:
    """One row: share of big gaps at seams and anywhere, and their ratio."""
    at = hits.agg(F.avg((F.col("gap_ms") > gap_ms).cast("double")).alias("at_seam"))
    rows = gaps.agg(F.avg((F.col("gap_ms") > gap_ms).cast("double")).alias("anywhere")).join(at)
    return rows.select(F.round("at_seam", 6).alias("at_seam"), F.round("anywhere", 6).alias("anywhere"), F.round(F.try_divide("at_seam", "anywhere"), 4).alias("ratio"))


def seam_suspects(hits: DataFrame, n: int = 20) -> DataFrame:
    return hits.orderBy(F.desc("gap_ms"), "call_id", "prev_e").limit(n)


def assemble_segments(utterances: DataFrame, segments: DataFrame, labels: DataFrame | None = None, min_ms: int = 1500) -> DataFrame:
    """segments with those of the utterances' calls replaced by the utterances with text.

    Numbered by start, not yet assigned to a side; the embedding stays only where it is long enough.
    ``labels`` (id, speaker) gives utterances (with an id) their speaker within the call, -1 where it
    has none. Ids are hashes of call and number, negative, so that they are none of those given so
    far. Other calls' segments keep all their columns; a call whose utterances have no text has none.
    """
    rows = utterances.withColumn("text_zh", strip_tags(F.col("text"))).where("text_zh <> ''")
    speaker = F.lit(None).cast("string")
    if labels is not None:
        rows = rows.join(labels.select(F.col("id").alias("_lid"), F.col("speaker").alias("_speaker")), F.col("id") == F.col("_lid"), "left")
        speaker = F.coalesce("_speaker", F.lit(-1)).cast("string")
    w = Window.partitionBy("call_id").orderBy("start_ms", "end_ms", "text_zh")
    voiced = F.when(F.col("end_ms") - F.col("start_ms") >= min_ms, F.col("embedding"))
    new = rows.select("call_id", (F.row_number().over(w) - 1).cast("int").alias("idx"), speaker.alias("spk_local"), F.lit("unknown").alias("who"), "start_ms", "end_ms", "text_zh", voiced.alias("embedding"))
    new = new.withColumn("id", F.xxhash64("call_id", "idx").bitwiseOR(F.lit(-(2**63))))
    new = new.drop(*[c for c in ("id", "spk_local") if c not in segments.columns])
    old = segments.join(utterances.select("call_id").distinct(), "call_id", "left_anti")
    return old.unionByName(new, allowMissingColumns=True).select(segments.columns)
