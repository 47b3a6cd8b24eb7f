"""Files, streams and whole chains as queries: what they read is derived from the given tables first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import fixtures as fx
from callweave.functions.components import cut, scratch
from callweave.operators import search_index
from callweave.plans import chain
from callweave.plans.voice_queries import W, _prints, _voices
from callweave.registry import query
from callweave.sources import recordings
from callweave.streaming.ledger import FileLedger
from callweave.streaming.scan import scan_listings


def _files(spark, d) -> str:
    """A folder with one text file for each source of documents, in a folder of its own."""
    root = scratch(spark, "files")
    t = spark.read.parquet(f"{d}/documents.parquet").where("source is not null and text is not null")
    t.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(root)
    return root


def _folder():
    return F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder")


@query("SELECT source AS folder, CAST(1 AS BIGINT) AS files FROM documents WHERE source <> 'src2' AND text IS NOT NULL GROUP BY 1")
def s1_list_files(spark, d):
    """The files made of documents, but for one folder that is left out."""
    found = recordings.list_recordings(spark, _files(spark, d), [".txt"], ["SOURCE=SRC2"])
    return found.groupBy(_folder()).agg(F.count("*").alias("files"))


@query("""WITH t AS (SELECT source, encode(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS b FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1), n AS (SELECT *, octet_length(b) AS n FROM t)
SELECT source AS folder, sha256(encode(CAST(n AS VARCHAR)) || b[1:65536] || CASE WHEN n > 131072 THEN b[n - 65535:n] ELSE encode('') END) AS probe_key, count(*) OVER () AS read_first, CAST(0 AS BIGINT) AS read_again FROM n""")
def s5_probe_table(spark, d):
    """Fingerprints by byte ranges of files; a second run finds all in the table of keys and reads no file."""
    listing = recordings.list_recordings(spark, _files(spark, d), [".txt"])
    folder = scratch(spark, "probes")
    _, first = recordings.ensure_probes(listing, folder)
    keys, again = recordings.ensure_probes(listing, folder)
    return keys.select(_folder(), "probe_key", F.lit(first).cast("long").alias("read_first"), F.lit(again).cast("long").alias("read_again"))


def _result_lines(spark, d) -> str:
    s, folder = fx.segments(spark, d), scratch(spark, "results")
    word = F.array(F.struct(F.lit("w").alias("w"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    row = F.to_json(F.struct("call_id", F.col("id").alias("seg_id"), F.lit(1).alias("attempt"), F.when(F.col("id") % 17 > 0, F.col("text_zh")).alias("text"), word.alias("words"), F.when(F.col("id") % 17 == 0, "oom").alias("error")))
    s.select(F.when(F.col("id") % 13 == 0, F.substring(row, 1, 20)).otherwise(row).alias("value")).write.text(folder)
    return folder


@query(f"{W} SELECT call_id, id AS seg_id, CASE WHEN id % 17 > 0 THEN text_zh END AS text, CASE WHEN id % 17 = 0 THEN 'oom' END AS error, start_ms AS first_ms FROM segments WHERE id % 13 > 0")
def s7_refine_results(spark, d):
    """Lines of results, every 13th of them cut off."""
    rows, _ = recordings.read_refine_results(spark, _result_lines(spark, d))
    return rows.select("call_id", "seg_id", "text", "error", F.get("words", F.lit(0))["s"].alias("first_ms"))


@query(f'{W} SELECT count(*) AS "read", count(*) FILTER (id % 13 = 0) AS broken, count(*) FILTER (id % 13 > 0 AND id % 17 = 0) AS errors FROM segments')
def s7_refine_counts(spark, d):
    return recordings.read_refine_results(spark, _result_lines(spark, d))[1]


LISTED = """SELECT '/rec/u' || CAST(user_id AS STRING) AS path, CAST(floor(value * 1000) AS BIGINT) AS length, ts AS modificationTime, event_id % 4 AS batch FROM events"""


@query(f"""WITH e AS ({LISTED}), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY batch, path ORDER BY modificationTime DESC, length DESC) = 1),
c AS (SELECT *, lag(length) OVER w AS pl, lag(modificationTime) OVER w AS pt, lag(true) OVER w AS had FROM l WINDOW w AS (PARTITION BY path ORDER BY batch))
SELECT path, length, modificationTime, CASE WHEN had THEN 'updated' ELSE 'added' END AS action, batch FROM c WHERE had IS NULL OR pl IS DISTINCT FROM length OR pt IS DISTINCT FROM modificationTime""")
def x1_stream_scan(spark, d):
    """Events as listings in four batches, streamed into a ledger; then all of them twice more, which adds nothing."""
    rows = cut(fx.frame(spark, d, LISTED).withColumn("modificationTime", F.col("modificationTime").cast("timestamp")))
    folder, ledger = scratch(spark, "listings"), FileLedger(spark, scratch(spark, "ledger"), compact_every=3)
    one, two = scratch(spark, "stream"), scratch(spark, "stream")
    for batch in range(4):
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(folder)
        scan_listings(spark, folder, one, ledger).awaitTermination()
    scan_listings(spark, folder, two, ledger).awaitTermination()  # a lost checkpoint: batch 0 again, with everything
    for batch in (3, 1):
        ledger(rows.where(F.col("batch") == batch).drop("batch"), batch)
    return ledger.changes().withColumn("modificationTime", F.col("modificationTime").cast("timestamp_ntz"))


def chain_tables(spark, d):
    """Calls, segments, contacts and voiceprints for a chain: the voices are segments of the calls of their numbers."""
    calls = fx.calls(spark, d).withColumn("call_time", F.col("call_time").cast("timestamp"))
    seg = _voices(spark, d).join(calls.select(F.col("id").alias("call_id")), "call_id", "left_semi")
    seg = seg.select("id", "call_id", (F.col("id") % 5).cast("int").alias("idx"), "spk_local", F.lit("unknown").alias("who"), F.lit(None).cast("long").alias("contact_id"), F.lit(None).cast("double").alias("contact_conf"), "start_ms", (F.col("start_ms") + 2500).alias("end_ms"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text_zh"), "embedding")
    calls = calls.withColumns({"speaker_map": F.lit(None).cast("string"), "line_kind": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "fulltext_zh": F.lit(None).cast("string")})
    contacts = fx.contacts(spark, d).withColumns({"note": F.lit(None).cast("string"), "parent_id": F.col("parent_id").cast("long")})
    prints = _prints(spark, d).withColumn("quality", F.lit(0.6))
    listing = calls.select("path", F.col("size_bytes").alias("length"), F.col("call_time").alias("modificationTime"))
    return {"calls": calls, "segments": seg, "contacts": contacts, "voiceprints": prints}, listing


@query()
def x2_run_chain(spark, d):
    """Segments after the whole chain, with the names of their contacts."""
    t, listing = chain_tables(spark, d)
    out = chain.run_chain(t, listing)
    names = out["contacts"].select(F.col("id").alias("contact_id"), "name")
    return out["segments"].join(names, "contact_id", "left").select("id", "call_id", "who", F.col("name").alias("contact"), F.round("contact_conf", 6).alias("conf"))


TERMS = ["THE ", "th%nd", "user1", "c_n"]


@query(f"""{W}, q(term) AS (VALUES {', '.join(f"('{t}')" for t in TERMS)}), s AS (SELECT DISTINCT term, call_id FROM segments, q WHERE text_zh ILIKE '%' || term || '%')
SELECT q.term, c.id FROM calls c CROSS JOIN q LEFT JOIN s ON s.term = q.term AND s.call_id = c.id WHERE dup_of IS NULL AND (filename ILIKE '%' || q.term || '%' OR summary ILIKE '%' || q.term || '%' OR s.call_id IS NOT NULL)""")
def q9_search_index(spark, d):
    """All calls that some terms find, through an index that two batches have made and one of them again."""
    calls, seg, folder = fx.calls(spark, d), fx.segments(spark, d), scratch(spark, "index")
    for batch in (0, 1, 1):
        search_index.add_to_index(folder, batch, calls.where(F.col("id") % 2 == batch), seg)
    found = [search_index.search_indexed(folder, calls, seg, fx.contacts(spark, d), t, size=None).select(F.lit(t).alias("term"), "id") for t in TERMS]
    return reduce(DataFrame.union, found)
