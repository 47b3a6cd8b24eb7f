"""Reference clips of voices: candidates, energy, score and a budget of seconds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.text import ILLEGAL
from callweave.operators.stats import recent


@F.pandas_udf(T.DoubleType())
def clip_energy(pcm: pd.Series) -> pd.Series:
    """Mean square of 16-bit samples as shares of full scale; null without a whole sample."""
    one = lambda b: None if b is None or len(b) < 2 else float((np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(float) / 32768).__pow__(2).mean() + 1e-9)
    return pd.Series([one(b) for b in pcm], dtype="float64")


def clip_score(seconds: Column, energy: Column) -> Column:
    return F.least(seconds, F.lit(12.0)) * F.when(energy > 0.15, 1.0).otherwise(0.4)


def clip_candidates(segments: DataFrame, calls: DataFrame, contacts: DataFrame, me: DataFrame | None = None, min_dur: float = 1.5, max_dur: float = 18.0) -> DataFrame:
    """(speaker, wav_path, start_ms, end_ms, text_zh, seconds) of every contact, and of me if known.

    Copies aren't left out. Energy, where it is known, is for the caller to join and to filter.
    """
    rows = segments.join(calls.where("wav_path is not null").select(F.col("id").alias("call_id"), "wav_path"), "call_id").withColumn("seconds", (F.col("end_ms") - F.col("start_ms")) / 1000.0)
    rows = rows.where(F.col("seconds").between(min_dur, max_dur) & (F.length("text_zh") >= 3))
    named = rows.where("who = 'other'").join(contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("speaker")), "contact_id")
    cols = ["speaker", "wav_path", "start_ms", "end_ms", "text_zh", "seconds"]
    out = named.select(cols)
    if me is not None:
        mine = rows.where("who = 'me'").join(F.broadcast(me.select(F.lit("_me").alias("speaker")).limit(1)))
        out = out.unionByName(mine.select(cols))
    return out


def select_clips(candidates: DataFrame, total: float = 40.0, min_dur: float = 1.5) -> DataFrame:
    """(speaker, clip, wav_path, start_ms, end_ms, seconds): the best until those before hold total seconds.

    Clips shorter than ``min_dur`` don't count, so that a speaker has total / min_dur clips at most:
    so many are kept within each partition before anything is shuffled, and their sums are taken.
    """
    cands = candidates.where((F.col("energy") >= 1e-5) & (F.col("seconds") >= min_dur)).withColumn("score", clip_score(F.col("seconds"), F.col("energy")))
    order = [F.desc("score"), F.desc("wav_path"), F.desc("start_ms"), F.desc("end_ms"), F.desc("text_zh")]
    few = recent(cands, ["speaker"], order, math.ceil(total / min_dur))
    w = Window.partitionBy("speaker").orderBy(*order)
    before = F.coalesce(F.sum(F.col("seconds").cast("decimal(18,3)")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = few.withColumns({"before": before, "no": F.row_number().over(w)}).where(F.col("before") < total)
    return rows.select("speaker", F.concat(F.lit("ref_"), F.lpad(F.col("no").cast("string"), 2, "0")).alias("clip"), "wav_path", "start_ms", "end_ms", "seconds")


def voice_manifest(clips: DataFrame) -> DataFrame:
    """(speaker, clips, total_sec), the speaker's name fit for a file name."""
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace("speaker", ILLEGAL, "")), F.lit("")), F.lit("unnamed"))
    return clips.groupBy(name.alias("speaker")).agg(F.sort_array(F.collect_list(F.struct("clip", "wav_path", "start_ms", "end_ms"))).alias("clips"), F.round(F.sum(F.col("seconds").cast("decimal(18,3)")), 1).cast("double").alias("total_sec"))
