"""Statistics, queue depths, search and reports over calls, segments and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.components import cut

DONE = ("transcribed", "analyzed")
#: Upper ends of the duration bins in seconds, and their names.
BINS = [(10, "<10s"), (30, "10-30s"), (60, "30s-1m"), (120, "1-2m"), (300, "2-5m"), (600, "5-10m"), (1800, "10-30m"), (3600, "30-60m"), (1e9, ">1h")]
UNKNOWN = "未知"


def live(calls: DataFrame) -> DataFrame:
    """Calls that aren't marked as copies."""
    return calls.where(F.col("dup_of").isNull())


def done() -> Column:
    return F.col("status").isin(*DONE)


def exact(x: Column) -> Column:
    """Seconds as decimals, so that sums don't depend on their order."""
    return x.cast("decimal(18,4)")


def rounded_sum(x: Column, unit: float, places: int) -> Column:
    return F.round(F.coalesce(F.sum(exact(x)), F.lit(0)).cast("double") / unit, places)


def bucket_name(t: Column, bucket: str) -> Column:
    """day, week (Monday first, from 00), month or year of a time, as text."""
    if bucket == "week":
        week = F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7)
        return F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(t, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[bucket])


def label() -> Column:
    return F.coalesce(F.nullif(F.col("contact_hint"), F.lit("")), F.nullif(F.col("phone"), F.lit("")))


def overview(calls: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row of totals: calls without copies, done, hours, first and last, contacts, orgs, copies."""
    is_live = F.col("dup_of").isNull()
    c = calls.agg(
        F.count_if(is_live).alias("total_calls"),
        F.count_if(is_live & done()).alias("done"),
        rounded_sum(F.when(is_live, F.col("duration_sec")), 3600, 2).alias("hours"),
        F.min(F.when(is_live, F.col("call_time"))).alias("first_call"),
        F.max(F.when(is_live, F.col("call_time"))).alias("last_call"),
        F.count_if(~is_live).alias("dup_copies"),
        rounded_sum(F.when(~is_live, F.col("duration_sec")), 3600, 2).alias("dup_hours"),
        F.coalesce(F.sum(F.when(~is_live, F.col("size_bytes"))), F.lit(0)).alias("dup_bytes"),
    )
    org = F.coalesce("kind", F.lit("person")) == "org"
    return c.join(contacts.agg(F.count_if(~org).alias("contacts"), F.count_if(org).alias("orgs")))


def timeline(calls: DataFrame, bucket: str = "month") -> DataFrame:
    rows = live(calls).where("call_time is not null").groupBy(bucket_name(F.col("call_time"), bucket).alias("bucket"))
    return rows.agg(F.count("*").alias("calls"), F.round(F.sum(exact(F.col("duration_sec"))).cast("double") / 60, 1).alias("minutes"))


def heatmap(calls: DataFrame) -> DataFrame:
    """Calls by weekday (Sunday 0) and hour; all 168 rows."""
    spark = calls.sparkSession
    grid = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    n = live(calls).where("call_time is not null").groupBy((F.dayofweek("call_time") - 1).alias("weekday"), F.hour("call_time").alias("hour")).count()
    return grid.join(n, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("count", F.lit(0)).alias("n"))


def top_contacts(calls: DataFrame, limit: int = 30, since: str | None = None, until: str | None = None) -> DataFrame:
    """Calls, minutes, first and last by contact; most calls first, then by name. A bare until date excludes its day."""
    rows = live(calls)
    if since:
        rows = rows.where(F.col("call_time") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(F.col("call_time") < F.lit(until).cast("timestamp") if len(until) == 10 else F.col("call_time") <= F.lit(until).cast("timestamp"))
    found = rows.groupBy(F.coalesce(label(), F.lit(UNKNOWN)).alias("name")).agg(
        F.count("*").alias("calls"), rounded_sum(F.col("duration_sec"), 60, 1).alias("minutes"), F.min("call_time").alias("first"), F.max("call_time").alias("last")
    )
    return found.orderBy(F.desc("calls"), "name").limit(limit)


def contact_timeline(segments: DataFrame, calls: DataFrame, contact_id: int, bucket: str = "month") -> DataFrame:
    mine = segments.where((F.col("who") == "other") & (F.col("contact_id") == contact_id)).select("call_id").distinct()
    rows = live(calls).where("call_time is not null").join(mine, calls["id"] == mine["call_id"], "left_semi")
    return rows.groupBy(bucket_name(F.col("call_time"), bucket).alias("bucket")).agg(F.count_distinct("id").alias("calls"))


def duration_histogram(calls: DataFrame) -> DataFrame:
    """Calls in each half-open bin; all nine rows."""
    which = F.lit(None).cast("string")
    for end, name in reversed(BINS):
        which = F.when(F.col("duration_sec") < end, name).otherwise(which)
    n = live(calls).where("duration_sec is not null").groupBy(which.alias("label")).count()
    bins = calls.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(x).alias("label")) for i, (_, x) in enumerate(BINS)])))
    return bins.join(n, "label", "left").select("no", "label", F.coalesce("count", F.lit(0)).alias("n"))


def source_stats(sources: DataFrame, calls: DataFrame) -> DataFrame:
    n = calls.groupBy("source_id").agg(
        F.count("*").alias("n_calls"), F.round(F.sum(exact(F.coalesce("duration_sec", F.lit(0.0)))).cast("double") / 3600, 2).alias("hours"),
        F.count_if(done()).alias("n_done"), F.count_if(F.col("status") == "error").alias("n_err"), F.count_if(F.col("duration_sec").isNull()).alias("n_nodur"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calls", "n_done", "n_err", "n_nodur")]
    return sources.join(n, sources["id"] == n["source_id"], "left").select("id", "name", "hours", *zero)


def status_counts(calls: DataFrame, by_source: bool = False, live_only: bool = False) -> DataFrame:
    """Calls by status; by source too; or copies under a status of their own."""
    status = F.when(F.col("dup_of").isNotNull(), F.lit("copy")).otherwise(F.col("status")) if live_only else F.col("status")
    return calls.groupBy(*(["source_id"] if by_source else []), status.alias("status")).agg(F.count("*").alias("n"))


def search_calls(calls, segments, contacts, q="", contact="", who="", date_from="", date_to="", status="", source=0, dup="", page=1, size: int | None = 25) -> DataFrame:
    """A page of matching calls, newest first, with the total and the names of the other side.

    As in SQL's LIKE, % and _ of the terms match anything. Segments are reduced to the ids of
    calls before anything is joined to calls. Without a size all matching calls come, in no order.
    """
    rows = live(calls) if dup == "" else calls.where("dup_of is not null") if dup == "only" else calls
    like = lambda c, x: F.coalesce(F.col(c).ilike(f"%{x}%"), F.lit(False))
    if date_from:
        rows = rows.where(F.col("call_time") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.where(F.date_trunc("second", F.col("call_time")) < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
    if status:
        rows = rows.where(F.col("status") == status)
    if source:
        rows = rows.where(F.col("source_id") == source)
    named = segments.join(contacts.select(F.col("id").alias("contact_id"), "name"), "contact_id", "left")
    if q or contact or who:
        # conditions on one segment hold for the same segment, those on the call for any
        text = like("text_zh", q) | (like("text_sv", q) if "text_sv" in segments.columns else F.lit(False)) if q else F.lit(True)
        of_call = lambda s, c: (s, c)
        seg = named.where((F.col("who") == who) if who else F.lit(True)).select("call_id", text.alias("seg_q"), (like("name", contact) if contact else F.lit(True)).alias("seg_c"))
        pairs = seg.groupBy("call_id").agg(F.max("seg_q").alias("any_q"), F.max("seg_c").alias("any_c"), F.max(F.col("seg_q") & F.col("seg_c")).alias("both"))
        call_q = like("filename", q) | like("summary", q) if q else F.lit(True)
        call_c = like("contact_hint", contact) | like("phone", contact) if contact else F.lit(True)
        rows = rows.join(pairs, rows["id"] == pairs["call_id"], "left")
        rows = rows.where(F.col("call_id").isNotNull()) if who else rows
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        rows = rows.where((call_q & call_c) | (call_q & no("any_c")) | (no("any_q") & call_c) | no("both"))
    total = rows.agg(F.count_distinct("id").alias("total"))
    chosen = rows if size is None else rows.orderBy(F.col("call_time").desc_nulls_last(), F.desc("id")).offset((page - 1) * size).limit(size)
    picked = cut(chosen.select("id", "filename", "contact_hint", "phone", "call_time", "duration_sec", "status"))
    # names of the page's calls only
    ids = picked.select(F.col("id").alias("call_id"))
    own = named.join(ids if size is None else F.broadcast(ids), "call_id", "left_semi")
    names = own.where("who = 'other' and name is not null").groupBy("call_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return picked.join(names, picked["id"] == names["call_id"], "left").drop("call_id").select("*", F.array_join("names", ",").alias("contact")).drop("names").join(F.broadcast(total))


def call_detail(calls: DataFrame, segments: DataFrame, contacts: DataFrame) -> DataFrame:
    """Calls with their segments in order as an array, with contact names."""
    named = segments.join(contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("contact_name")), "contact_id", "left")
    rows = named.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "who", "start_ms", "end_ms", "text_zh", "contact_name"))).alias("segments"))
    return calls.join(rows, calls["id"] == rows["call_id"], "left").drop("call_id")


def search_contacts(contacts: DataFrame, segments: DataFrame, q: str = "") -> DataFrame:
    n = segments.where("who = 'other'").groupBy("contact_id").agg(F.count("*").alias("n_segments"))
    rows = contacts.where(F.col("name").ilike(f"%{q}%") | F.coalesce(F.col("phone").ilike(f"%{q}%"), F.lit(False))) if q else contacts
    return rows.join(n, rows["id"] == n["contact_id"], "left").select(rows["id"], "name", "phone", "n_calls", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def archive_report(calls: DataFrame, segments: DataFrame, contacts: DataFrame) -> DataFrame:
    """(item, n): totals over all calls, copies included, and calls by status."""
    one = lambda df, item, col=None: df.agg((col if col is not None else F.count("*")).cast("double").alias("n")).select(F.lit(item).alias("item"), "n")
    status = calls.groupBy("status").agg(F.count("*").cast("double").alias("n")).select(F.concat(F.lit("status:"), F.col("status")).alias("item"), "n")
    parts = [one(calls, "calls"), one(calls, "hours", rounded_sum(F.col("duration_sec"), 3600, 2)), one(calls, "summaries", F.count("summary")), one(segments, "segments"), one(segments, "me_segments", F.count_if(F.col("who") == "me")), one(contacts, "contacts")]
    out = status
    for p in parts:
        out = out.unionByName(p)
    return out


def queue_depths(calls: DataFrame) -> DataFrame:
    """One row: calls to transcribe, to summarise, without an audio key."""
    is_live = F.col("dup_of").isNull()
    key = F.col("audio_key").isNull() if "audio_key" in calls.columns else F.lit(True)
    return calls.agg(
        F.count_if(is_live & F.col("status").isin("pending", "normalized")).alias("pending_transcribe"),
        F.count_if(is_live & (F.col("status") == "transcribed") & F.col("summary").isNull()).alias("pending_summarize"),
        F.count_if(key).alias("pending_dedup"),
    )


def pending_refine(calls: DataFrame, outputs: DataFrame, engine: str = "qwen3-asr") -> DataFrame:
    """Done calls with a wav that the engine has no output for; their ids."""
    rows = live(calls).where(done() & F.col("wav_path").isNotNull())
    have = outputs.where(F.col("engine") == engine).select("call_id")
    return rows.join(have, rows["id"] == have["call_id"], "left_anti").select("id")


def pending_align(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """Ids of calls that labelling or contact matching would change."""
    voiced = segments.where("embedding is not null")
    rows = live(calls)
    label_me = rows.where(done() & F.col("speaker_map").isNull()).join(voiced, rows["id"] == voiced["call_id"], "left_semi").select("id")
    other = voiced.where("who = 'other' and contact_id is null")
    return label_me.unionByName(rows.join(other, rows["id"] == other["call_id"], "left_semi").select("id")).distinct()


def line_preview(calls: DataFrame, extra_names: list[str] | None = None) -> DataFrame:
    from callweave.functions.text import classify_line

    kind = classify_line(label(), F.col("phone"), extra_names)
    return live(calls).agg(F.count_if(kind == "shared_line").alias("n_shared"))


def recent(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    return df.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_no") <= n).drop("_no")
