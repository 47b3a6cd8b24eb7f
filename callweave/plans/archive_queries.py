"""Duplicates, transcripts, texts and the graph as queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import fixtures as fx
from callweave.functions import text as tx
from callweave.functions.components import scratch
from callweave.operators import dedup, graph, transcripts
from callweave.registry import query

W = fx.with_tables()
KEY = "coalesce(CAST(size_bytes AS VARCHAR), '-') || '|' || coalesce(CAST(CAST(round(duration_sec, 1) AS DECIMAL(18,1)) AS VARCHAR), '-')"
RANK = "CASE status WHEN 'analyzed' THEN 4 WHEN 'transcribed' THEN 3 WHEN 'normalized' THEN 2 WHEN 'pending' THEN 1 WHEN 'skipped' THEN 0 WHEN 'error' THEN 0 ELSE 1 END"
NOISY = "CAST(regexp_matches(lower(path), '副本|copy|backup|备份|bak') AS INT)"
DEPTH = "len(list_filter(string_split(path, '/'), lambda p: p <> '')) + 1"


def _docs(spark, d):
    """The documents as calls, with times that their minutes give."""
    rows = fx.doc_calls(spark, d)
    return rows.withColumns({"call_time": F.timestamp_seconds(F.lit(1704067200) + F.col("minute_key") * 60), "dup_of": F.lit(None).cast("long"), "dup_reason": F.lit(None).cast("string")})


def _texts(calls):
    return calls.select("id", F.col("fulltext_zh").alias("text"))


# -- duplicates -----------------------------------------------------------------------------------


@query(f"{W} SELECT id, {KEY} AS audio_key FROM calls")
def d1_audio_keys(spark, d):
    return dedup.assign_audio_key(fx.calls(spark, d)).select("id", "audio_key")


EXACT = f"""{W}, k AS (SELECT *, {KEY} AS audio_key FROM calls), manual AS (SELECT DISTINCT dup_of FROM calls WHERE dup_reason LIKE '手动%' AND dup_of IS NOT NULL),
free AS (SELECT * FROM k WHERE dup_of IS NULL OR dup_of IN (SELECT dup_of FROM manual)), c AS (SELECT * FROM free WHERE audio_key IN (SELECT audio_key FROM free GROUP BY 1 HAVING count(*) > 1))"""


@query(f"{EXACT} SELECT id, audio_key FROM c")
def d2_exact_candidates(spark, d):
    return dedup.exact_candidates(dedup.assign_audio_key(fx.calls(spark, d))).select("id", "audio_key")


@query(f"""{EXACT} SELECT audio_key, id AS canonical FROM c LEFT JOIN (SELECT dup_of AS mid FROM manual) ON mid = id
QUALIFY row_number() OVER (PARTITION BY audio_key ORDER BY (mid IS NOT NULL) DESC, {RANK} DESC, {NOISY}, {DEPTH}, call_time NULLS LAST, path) = 1""")
def d3_pick_canonical(spark, d):
    calls = dedup.assign_audio_key(fx.calls(spark, d))
    return dedup.pick_canonical(dedup.exact_candidates(calls), dedup._manual(calls))


@query()
def d4_verify_exact(spark, d):
    calls = dedup.assign_audio_key(_docs(spark, d))
    c = dedup.exact_candidates(calls)
    return dedup.verify_exact(c, dedup.pick_canonical(c, dedup._manual(calls)), _texts(calls))


@query(f"""{W}, t AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(minute_key) AS minute FROM doc_calls)
SELECT a.id AS a, b.id AS b, a.contact_hint AS who, a.minute FROM t a JOIN t b ON a.contact_hint = b.contact_hint AND a.minute = b.minute AND a.id < b.id AND abs(a.duration_sec - b.duration_sec) <= 2""")
def d5_near_candidates(spark, d):
    return dedup.near_candidates(_docs(spark, d))


@query()
def d6_near_groups(spark, d):
    calls = _docs(spark, d)
    return dedup.near_components(calls, _texts(calls))


@query()
def d7_mark_duplicates(spark, d):
    calls = _docs(spark, d)
    return dedup.mark_duplicates(calls, _texts(calls)).select("id", "status", "dup_of", "dup_reason")


@query(f"""{W} SELECT id, CASE WHEN dup_reason LIKE '自动判重%' THEN NULL ELSE dup_of END AS dup_of, CASE WHEN dup_reason LIKE '自动判重%' THEN NULL ELSE dup_reason END AS dup_reason,
CASE WHEN status = 'skipped' AND (dup_of IS NULL OR dup_reason LIKE '自动判重%') THEN 'pending' ELSE status END AS status FROM calls""")
def d8_clear_auto_marks(spark, d):
    return dedup.clear_auto_marks(fx.calls(spark, d)).select("id", "dup_of", "dup_reason", "status")


@query(f"""{W}, g AS (SELECT coalesce(dup_of, id) AS grp, min(id) AS pick FROM calls WHERE id % 17 = 1 AND id % 2 = 0 GROUP BY 1)
SELECT id, CASE WHEN id = pick THEN NULL WHEN pick IS NOT NULL THEN pick ELSE dup_of END AS dup_of, CASE WHEN id = pick THEN NULL WHEN pick IS NOT NULL THEN '手动指定' ELSE dup_reason END AS dup_reason FROM calls LEFT JOIN g ON grp = coalesce(dup_of, id)""")
def d9_set_canonical(spark, d):
    calls = fx.calls(spark, d)
    return dedup.set_canonical(calls, calls.where("id % 17 = 1 and id % 2 = 0").select("id")).select("id", "dup_of", "dup_reason")


@query(f"{W} SELECT id, CASE WHEN id % 34 = 1 THEN NULL ELSE dup_of END AS dup_of, CASE WHEN status = 'skipped' AND id % 34 = 1 THEN 'pending' ELSE status END AS status FROM calls")
def d10_unmark(spark, d):
    calls = fx.calls(spark, d)
    return dedup.unmark(calls, calls.where("id % 34 = 1").select("id")).select("id", "dup_of", "status")


@query(f"{W} SELECT count(*) AS copies, count(DISTINCT dup_of) AS groups, round(CAST(coalesce(sum(CAST(duration_sec AS DECIMAL(18,4))), 0) AS DOUBLE), 1) AS seconds, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM calls WHERE dup_of IS NOT NULL")
def d11_dedup_summary(spark, d):
    return dedup.dedup_summary(fx.calls(spark, d))


@query(f"{W}, c AS (SELECT dup_of, string_agg(id, ',' ORDER BY id) AS copies FROM calls WHERE dup_of IS NOT NULL GROUP BY 1) SELECT id AS canonical, path, copies FROM calls JOIN c ON c.dup_of = id ORDER BY id LIMIT 50")
def d12_list_groups(spark, d):
    return dedup.list_groups(fx.calls(spark, d), 50).select("canonical", "path", F.array_join(F.transform("copies", lambda c: c["id"].cast("string")), ",").alias("copies"))


@query(f"{W} SELECT id, CASE WHEN phone = '95588' THEN 'shared_line' ELSE 'person' END AS line_kind, true AS line_changed FROM calls")
def d13_classify_calls(spark, d):
    """All numbers but one are mobiles, which are persons' whatever they end in."""
    return dedup.classify_calls(fx.calls(spark, d), mobile_ends=False).select("id", "line_kind", "line_changed")


# -- texts ----------------------------------------------------------------------------------------

NAMES = "SELECT event_id AS id, 'rec ' || CAST(event_id AS STRING) || strftime(ts, '_%Y%m%d_%H%M%S_') || CAST(13800000000 + user_id AS STRING) || ' Wang.wav' AS filename, ts FROM events"


def _names(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.col("ts")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("rec "), F.col("event_id").cast("string"), F.date_format(ts, "_yyyyMMdd_HHmmss_"), (F.col("user_id") + 13800000000).cast("string"), F.lit(" Wang.wav")).alias("filename"), "ts")


@query(f"WITH n AS ({NAMES}) SELECT id, date_trunc('second', ts) AS call_time, regexp_extract(filename, '_(1\\d{{10}}) ', 1) AS phone, 'Wang' AS name, 'compact_datetime' AS matched_by FROM n")
def t11_parse_filename(spark, d):
    return _names(spark, d).select("id", tx.parse_filename("filename").alias("p")).select("id", F.col("p.call_time").cast("timestamp_ntz").alias("call_time"), "p.phone", "p.name", "p.matched_by")


@query(f"WITH n AS ({NAMES}) SELECT id, date_trunc('second', ts) AS compact, '1' || regexp_extract(filename, '_1(\\d{{10}}) ', 1) AS phone, 'Wang' AS latin FROM n")
def t4_name_parts(spark, d):
    n = F.col("filename")
    bare = F.regexp_replace(n, r"\.wav$", "")
    return _names(spark, d).select("id", tx.parse_compact_datetime(n).cast("timestamp_ntz").alias("compact"), tx.extract_phone(F.regexp_replace(n, tx.COMPACT, " ")).alias("phone"), tx.latin_name(F.regexp_replace(bare, "rec", "rec ")).alias("latin"))


@query(f"{W} SELECT id, {RANK} AS rank, {NOISY} AS noisy, {DEPTH} AS depth FROM doc_calls")
def t16_status_and_path(spark, d):
    p = tx.path_score(F.col("path"))
    return fx.doc_calls(spark, d).select("id", tx.status_rank(F.col("status")).alias("rank"), p["noisy"].alias("noisy"), p["depth"].alias("depth"))


@query(f"{W} SELECT id, CASE WHEN analysis IS NULL THEN substr('no json ' || id, 1, 200) ELSE 's' || id END AS summary, analysis IS NULL AS raw FROM calls")
def t17_extract_json(spark, d):
    answer = F.coalesce(F.concat(F.lit("```json\n"), "analysis", F.lit("\n```")), F.concat(F.lit("no json "), F.col("id").cast("string")))
    return fx.calls(spark, d).select("id", tx.extract_json(answer).alias("a")).select("id", "a.summary", F.coalesce("a.raw", F.lit(False)).alias("raw"))


TRANSCRIPTS = """tr AS (SELECT call_id, string_agg('[' || CASE who WHEN 'me' THEN '我' WHEN 'other' THEN coalesce(nullif(name, ''), '对方') ELSE '某人' END || '] ' || coalesce(text_zh, ''), chr(10) ORDER BY idx, s.id) AS transcript
FROM segments s LEFT JOIN contacts c ON c.id = s.contact_id GROUP BY 1)"""


@query(f"{W}, {TRANSCRIPTS} SELECT * FROM tr")
def t18_transcript_text(spark, d):
    return tx.transcript_text(fx.segments(spark, d), fx.contacts(spark, d))


@query(f"{W}, j AS (SELECT call_id, string_agg(text_zh, '' ORDER BY idx, id) AS t FROM segments WHERE text_zh IS NOT NULL GROUP BY 1) SELECT c.id, coalesce(t, '') AS text FROM calls c LEFT JOIN j ON call_id = c.id")
def t19_call_fulltext(spark, d):
    return tx.call_fulltext(fx.calls(spark, d), fx.segments(spark, d))


@query(f"""{W}, {TRANSCRIPTS} SELECT id, CASE WHEN trim(coalesce(transcript, '')) <> '' THEN 'Summarise: ' || substr(transcript, 1, 6000) END AS prompt,
CASE WHEN trim(coalesce(transcript, '')) = '' THEN '(空)' END AS summary, CASE WHEN trim(coalesce(transcript, '')) = '' THEN 'analyzed' ELSE status END AS status FROM calls LEFT JOIN tr ON call_id = id WHERE status = 'transcribed' AND summary IS NULL AND dup_of IS NULL""")
def t20_summary_prompts(spark, d):
    return tx.summary_prompts(fx.calls(spark, d), tx.transcript_text(fx.segments(spark, d), fx.contacts(spark, d)), "Summarise: ")


@query(f"""{W} SELECT id, CASE WHEN id % 3 = 0 AND id % 2 > 0 THEN 'a' || id ELSE summary END AS summary, CASE WHEN id % 3 = 0 AND id % 2 > 0 THEN 'analyzed' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 'timeout' END AS error FROM calls""")
def t21_apply_summaries(spark, d):
    calls = fx.calls(spark, d)
    r = calls.where("id % 3 = 0").select("id", F.concat(F.lit('{"summary":"a'), F.col("id").cast("string"), F.lit('"}')).alias("answer"), F.when(F.col("id") % 2 == 0, "timeout").alias("failure"))
    return tx.apply_summaries(calls, r).select("id", "summary", "status", "error")


@query()
def t15_text_similarity(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    b = t.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    return t.join(b.hint("merge"), "doc_id").select("doc_id", F.round(tx.text_similarity("before", "text"), 9).alias("similarity"))


# -- transcripts ----------------------------------------------------------------------------------


@query(f"""{W}, k AS (SELECT *, max(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM segments WHERE end_ms - start_ms >= 500),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start_ms - b >= 350 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM k) SELECT call_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY call_id, g""")
def a1_merge_intervals(spark, d):
    return transcripts.merge_intervals(fx.segments(spark, d))


@query(f"{W} SELECT id FROM segments WHERE end_ms - start_ms >= 1500")
def a2_embeddable(spark, d):
    return transcripts.embeddable(fx.segments(spark, d)).select("id")


CHUNKS = """ch AS (SELECT call_id, id AS seg_id, CAST(n AS INT) AS chunk_no, start_ms + n * 20000 AS start_ms, least(start_ms + (n + 1) * 20000, greatest(end_ms, start_ms + 400)) AS end_ms
FROM segments, range(1000) r(n) WHERE start_ms + n * 20000 < greatest(end_ms, start_ms + 400))"""


@query(f"{W}, {CHUNKS} SELECT * FROM ch")
def a3_split_chunks(spark, d):
    return transcripts.split_chunks(fx.segments(spark, d))


@query(f"""{W.replace('WITH', 'WITH RECURSIVE', 1)}, {CHUNKS}, s AS (SELECT seg_id, count(*) AS n, row_number() OVER (ORDER BY call_id, seg_id) AS no FROM ch GROUP BY call_id, seg_id),
walk(no, seg_id, n, held, batch) AS (SELECT no, seg_id, n, n, CAST(0 AS BIGINT) FROM s WHERE no = 1 UNION ALL
SELECT s.no, s.seg_id, s.n, CASE WHEN held + s.n > 4 THEN s.n ELSE held + s.n END, CASE WHEN held + s.n > 4 THEN batch + 1 ELSE batch END FROM walk JOIN s ON s.no = walk.no + 1)
SELECT seg_id, n AS n_chunks, batch FROM walk""")
def a4_pack_batches(spark, d):
    return transcripts.pack_batches(transcripts.split_chunks(fx.segments(spark, d)), piece=500)


def _results(spark, d):
    """Refined texts: every 19th segment has none, every 7th two."""
    s = fx.segments(spark, d)
    word = F.array(F.struct(F.lit("w").alias("w"), F.col("start_ms").alias("s"), (F.col("start_ms") + 300).alias("e")))
    first = s.where("id % 19 > 0").select("call_id", F.col("id").alias("seg_id"), F.lit(1).cast("long").alias("attempt"), F.concat(F.lit("R:"), "text_zh").alias("text"), F.lit("en").alias("lang"), word.alias("words"), F.lit(None).cast("string").alias("error"))
    return first.unionByName(first.where("seg_id % 7 = 0").withColumns({"attempt": F.lit(2).cast("long"), "text": F.concat("text", F.lit("!"))}))


@query(f"""{W}, {CHUNKS} SELECT seg_id, coalesce(string_agg('t' || chunk_no, '' ORDER BY chunk_no) FILTER (chunk_no <> 1), '') AS text, max(CASE WHEN chunk_no > 0 THEN 'en' END) AS lang,
max(start_ms) + 9 AS last_e, CAST(count(*) AS INTEGER) AS blocks, CAST(count(*) FILTER (chunk_no = 1) AS INTEGER) AS empty_blocks FROM ch GROUP BY seg_id""")
def a5_stitch_chunks(spark, d):
    c = transcripts.split_chunks(fx.segments(spark, d))
    word = F.array(F.struct(F.lit("w").alias("w"), F.lit(5).cast("long").alias("s"), F.lit(9).cast("long").alias("e")))
    rows = c.select("seg_id", "chunk_no", "start_ms", F.when(F.col("chunk_no") != 1, F.concat(F.lit("t"), "chunk_no")).alias("text"), F.when(F.col("chunk_no") > 0, "en").alias("lang"), word.alias("words"))
    out = transcripts.stitch_chunks(rows)
    return out.select("seg_id", "text", "lang", F.array_max(F.col("words.e")).alias("last_e"), "blocks", "empty_blocks")


COMPLETE = "ok AS (SELECT call_id FROM segments GROUP BY 1 HAVING count(*) = count(*) FILTER (id % 19 > 0))"


@query(f"{W}, {COMPLETE} SELECT call_id, id AS seg_id, 'R:' || text_zh || CASE WHEN id % 7 = 0 THEN '!' ELSE '' END AS text FROM segments WHERE call_id IN (FROM ok) AND id % 19 > 0")
def a6_latest_complete(spark, d):
    return transcripts.latest_complete(_results(spark, d), fx.segments(spark, d)).select("call_id", "seg_id", "text")


@query(f"""{W}, {COMPLETE}, h AS (SELECT *, call_id IN (FROM ok) AS hit, id % 3 = 0 AS before FROM segments) SELECT id, CASE WHEN before THEN 'first' WHEN hit AND id % 11 > 0 THEN text_zh END AS text_sv,
CASE WHEN hit AND id % 11 > 0 THEN 'R:' || text_zh || CASE WHEN id % 7 = 0 THEN '!' ELSE '' END ELSE text_zh END AS text_zh, start_ms, CASE WHEN hit AND id % 5 > 0 THEN start_ms + 300 ELSE end_ms END AS end_ms,
CASE WHEN hit AND id % 5 > 0 THEN 'qwen3-aligner' WHEN before THEN 'vad' END AS align_source, CASE WHEN hit AND id % 5 > 0 THEN 0.9::DOUBLE WHEN before THEN 0.5::DOUBLE END AS ts_confidence FROM h""")
def a7_fold_refined(spark, d):
    """Some segments were refined before; some results have no text, some no words."""
    s, old = fx.segments(spark, d), F.col("id") % 3 == 0
    s = s.withColumns({"text_sv": F.when(old, "first"), "align_source": F.when(old, "vad"), "ts_confidence": F.when(old, 0.5)})
    r = transcripts.latest_complete(_results(spark, d), s)
    r = r.withColumns({"text": F.when(F.col("seg_id") % 11 > 0, F.col("text")).otherwise(""), "words": F.when(F.col("seg_id") % 5 > 0, F.col("words"))})
    return transcripts.fold_refined(s, r).select("id", "text_sv", "text_zh", "start_ms", "end_ms", "align_source", "ts_confidence")


OUTS = """o AS (SELECT call_id, string_agg('R:' || text_zh, ' ' ORDER BY id) FILTER (text_zh <> '') AS first, string_agg('S:' || text_zh, ' ' ORDER BY id) FILTER (text_zh <> '') AS second, count(*) AS n FROM segments GROUP BY 1)"""


@query(f"""{W}, {OUTS} SELECT call_id, 'qwen3-asr' AS engine, CASE WHEN call_id % 3 = 0 THEN 2 ELSE 1 END AS attempt, 'en' AS lang, CASE WHEN call_id % 3 = 0 THEN second ELSE first END AS text, CAST(n AS INTEGER) AS n_words FROM o
UNION ALL SELECT call_id, 'other', 1, 'de', 'kept', 0 FROM o WHERE call_id % 2 = 0""")
def a7_merge_outputs(spark, d):
    """Three batches of outputs into one table: all calls, a second attempt of some, and both again."""
    s = fx.segments(spark, d)
    word = F.array(F.struct(F.lit("w").alias("w"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    made = lambda n, mark: s.select("call_id", F.col("id").alias("seg_id"), F.lit(n).cast("long").alias("attempt"), F.lit("en").alias("lang"), F.concat(F.lit(mark), "text_zh").alias("text"), word.alias("words"))
    first, second = transcripts.outputs_of(made(1, "R:")), transcripts.outputs_of(made(2, "S:").where("call_id % 3 = 0"))
    no_words = F.array().cast("array<struct<w:string,s:bigint,e:bigint>>")
    other = s.where("call_id % 2 = 0").select("call_id", F.lit("other").alias("engine"), F.lit(1).cast("long").alias("attempt"), F.lit("de").alias("lang"), F.lit("kept").alias("text"), no_words.alias("words")).distinct()
    folder = scratch(spark, "outputs")
    for batch in (first.unionByName(other), second, second, first):
        out = transcripts.merge_outputs(folder, batch, 16)
    return out.select("call_id", "engine", F.col("attempt").cast("int").alias("attempt"), "lang", "text", F.size("words").alias("n_words"))


@query(f"""{W}, {COMPLETE}, f AS (SELECT call_id, string_agg('R:' || text_zh || CASE WHEN id % 7 = 0 THEN '!' ELSE '' END, ' ' ORDER BY idx, id) AS t FROM segments WHERE call_id IN (FROM ok) GROUP BY 1)
SELECT DISTINCT call_id AS id, coalesce(t, 'old') AS fulltext_zh FROM segments LEFT JOIN f USING (call_id)""")
def a7_rebuild_fulltext(spark, d):
    s = fx.segments(spark, d)
    r = transcripts.latest_complete(_results(spark, d), s)
    calls = s.select(F.col("call_id").alias("id"), F.lit("old").alias("fulltext_zh")).distinct()
    return transcripts.rebuild_fulltext(calls, transcripts.fold_refined(s, r), r).select("id", "fulltext_zh")


@query(f"{W}, {CHUNKS}, n AS (SELECT seg_id, count(*) AS n FROM ch GROUP BY 1) SELECT count(*) AS segments, count(*) FILTER (n > 1) AS split_segments, CAST(sum(n - 1) AS BIGINT) AS seams, (SELECT max(end_ms - start_ms) FROM segments) AS longest_ms FROM n")
def a8_seam_counts(spark, d):
    return transcripts.seam_counts(fx.segments(spark, d))


WORDS = """wr AS (SELECT call_id, start_ms, unnest(range(len(string_split(text_zh, ' ')))) AS pos FROM segments),
words AS (SELECT call_id, start_ms + pos * 400 + (pos % 7) * 100 AS s, start_ms + pos * 400 + (pos % 7) * 100 + 150 + (pos % 5) * 50 AS e FROM wr),
g0 AS (SELECT call_id, e AS prev_e, lead(s) OVER (PARTITION BY call_id ORDER BY s, e) AS next_s FROM words), gaps AS (SELECT *, next_s - prev_e AS gap_ms FROM g0 WHERE next_s >= prev_e)"""
HITS = "seams AS (SELECT call_id, start_ms + n * 1500 AS seam_ms FROM segments, range(1, 1000) r(n) WHERE start_ms + n * 1500 < greatest(end_ms, start_ms + 400)), hits AS (SELECT g.call_id, prev_e, next_s, gap_ms, min(seam_ms) AS seam_ms FROM gaps g JOIN seams s ON s.call_id = g.call_id AND seam_ms BETWEEN prev_e AND next_s GROUP BY ALL)"


def _words(spark, d):
    rows = fx.segments(spark, d).select("call_id", "start_ms", F.posexplode(F.split("text_zh", " ")).alias("pos", "w"))
    s = F.col("start_ms") + F.col("pos") * 400 + (F.col("pos") % 7) * 100
    return rows.select("call_id", "w", s.alias("s"), (s + 150 + (F.col("pos") % 5) * 50).alias("e"))


@query(f"{W}, {WORDS} SELECT * FROM gaps")
def a9_word_gaps(spark, d):
    return transcripts.word_gaps(_words(spark, d))


@query(f"{W}, {WORDS}, {HITS} SELECT * FROM hits")
def a10_seam_hits(spark, d):
    return transcripts.seam_hits(transcripts.word_gaps(_words(spark, d)), transcripts.seams(fx.segments(spark, d), 1500))


@query(f"{W}, {WORDS}, {HITS} SELECT round(a, 6) AS at_seam, round(b, 6) AS anywhere, round(a / nullif(b, 0), 4) AS ratio FROM (SELECT (SELECT avg(CAST(gap_ms > 100 AS DOUBLE)) FROM hits) AS a, (SELECT avg(CAST(gap_ms > 100 AS DOUBLE)) FROM gaps) AS b)")
def a11_seam_risk(spark, d):
    gaps = transcripts.word_gaps(_words(spark, d))
    return transcripts.seam_risk(gaps, transcripts.seam_hits(gaps, transcripts.seams(fx.segments(spark, d), 1500)), 100)


@query(f"{W}, {WORDS}, {HITS} SELECT * FROM hits ORDER BY gap_ms DESC, call_id, prev_e LIMIT 20")
def a12_seam_suspects(spark, d):
    return transcripts.seam_suspects(transcripts.seam_hits(transcripts.word_gaps(_words(spark, d)), transcripts.seams(fx.segments(spark, d), 1500)))


@query(f"""{W}, n AS (SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY start_ms, end_ms) - 1 AS INT) AS idx, 'unknown' AS who, CAST(NULL AS BIGINT) AS contact_id, CAST(id % 2 AS VARCHAR) AS spk_local, start_ms, end_ms, trim(regexp_replace(text_zh, '\\s+', ' ', 'g')) AS text_zh, end_ms - start_ms >= 1500 AS voiced FROM segments WHERE call_id % 2 = 0 AND length(trim(text_zh)) > 0)
SELECT * FROM n UNION ALL SELECT call_id, idx, who, contact_id, 'kept', start_ms, end_ms, text_zh, false FROM segments WHERE call_id % 2 = 1""")
def a13_assemble_segments(spark, d):
    """Calls of even numbers anew, with labels of their speakers; the others keep their columns."""
    s = fx.segments(spark, d).withColumns({"embedding": F.lit(None).cast("array<double>"), "spk_local": F.lit("kept")})
    u = s.where("call_id % 2 = 0").select("id", "call_id", "start_ms", "end_ms", F.concat(F.lit("<|en|> "), "text_zh").alias("text"), F.array(F.lit(1.0)).alias("embedding"))
    out = transcripts.assemble_segments(u, s, u.select("id", (F.col("id") % 2).cast("int").alias("speaker")))
    return out.select("call_id", "idx", "who", "contact_id", "spk_local", "start_ms", "end_ms", "text_zh", F.col("embedding").isNotNull().alias("voiced"))


# -- graph ----------------------------------------------------------------------------------------

KEYS = ["the", "ing", "ndhe"]
SERVICE = f"""sv AS (SELECT c.id FROM calls c JOIN (SELECT call_id, string_agg(text_zh, ' ' ORDER BY idx) AS t FROM segments GROUP BY 1) s ON call_id = c.id
WHERE dup_of IS NULL AND status IN ('transcribed','analyzed') AND ({' + '.join(f"CAST(contains(t, '{k}') AS INT)" for k in KEYS)} >= 3 - 1 OR ({' + '.join(f"CAST(contains(t, '{k}') AS INT)" for k in KEYS)} >= 1 AND coalesce(duration_sec, 0) <= 180)))"""
LIVE = "lv AS (SELECT * FROM calls WHERE dup_of IS NULL AND id NOT IN (SELECT id FROM sv))"
TALKED = "tk AS (SELECT contact_id, count(*) AS weight, max(call_time) AS edge_time FROM segments s JOIN lv ON lv.id = s.call_id WHERE who = 'other' AND contact_id IS NOT NULL GROUP BY 1)"
EVENTS = """ev AS (SELECT id AS call_id, CAST(i AS INT) AS no, trim(json_extract_string(analysis, '$.events[' || i || ']')) AS title, call_time AS event_time, contact_hint, coalesce(nullif(contact_hint, ''), nullif(phone, ''), '对方') AS other FROM lv, range(6) r(i)
WHERE analysis IS NOT NULL AND trim(coalesce(json_extract_string(analysis, '$.events[' || i || ']'), '')) <> '')"""
TOPICS = "tp AS (SELECT DISTINCT json_extract_string(analysis, '$.topics[' || i || ']') AS topic, id AS call_id, call_time AS edge_time FROM lv, range(6) r(i) WHERE analysis IS NOT NULL AND json_extract_string(analysis, '$.topics[' || i || ']') IS NOT NULL)"
NODES = """nd AS (SELECT 'me' AS node, 'me' AS type, '我' AS label UNION ALL SELECT 'contact:' || id, 'contact', name FROM contacts UNION ALL SELECT 'event:' || call_id || ':' || no, 'event', title FROM ev UNION ALL SELECT DISTINCT 'topic:' || topic, 'topic', topic FROM tp)"""
INVOLVES = "iv AS (SELECT 'me' AS src, call_id, no, event_time AS edge_time FROM ev UNION ALL SELECT 'contact:' || c.id, call_id, no, event_time FROM ev JOIN (SELECT name, min(id) AS id FROM contacts GROUP BY 1) c ON c.name = ev.contact_hint)"
EDGES = """ed AS (SELECT 'me' AS src, 'contact:' || contact_id AS dst, 'talked' AS kind, weight, CAST(NULL AS BIGINT) AS call_id, edge_time FROM tk WHERE contact_id IN (SELECT id FROM contacts)
UNION ALL SELECT src, 'event:' || call_id || ':' || no, 'involves', 1, call_id, edge_time FROM iv UNION ALL SELECT 'me', 'topic:' || topic, 'topic', 1, call_id, edge_time FROM tp)"""
G = f"{W}, {SERVICE}, {LIVE}, {TALKED}, {EVENTS}, {TOPICS}, {NODES}, {INVOLVES}, {EDGES}"


def _graph(spark, d):
    calls, seg, con = fx.calls(spark, d), fx.segments(spark, d), fx.contacts(spark, d)
    sv = graph.service_calls(calls, seg, KEYS)
    ev, tp = graph.extract_events(calls, sv), graph.topic_edges(calls, sv)
    return calls, seg, con, sv, ev, tp


@query(f"{G} SELECT * FROM sv")
def g1_service_calls(spark, d):
    return _graph(spark, d)[3]


@query(f"{G} SELECT * FROM nd")
def g2_graph_nodes(spark, d):
    _, _, con, _, ev, tp = _graph(spark, d)
    return graph.graph_nodes(con, ev, tp)


@query(f"{G} SELECT * FROM tk")
def g3_talked_edges(spark, d):
    calls, seg, _, sv, _, _ = _graph(spark, d)
    return graph.talked_edges(seg, calls, sv)


@query(f"{G} SELECT call_id, no, title, event_time, other FROM ev")
def g4_extract_events(spark, d):
    return _graph(spark, d)[4].select("call_id", "no", "title", "event_time", F.get("participants", F.lit(0)).alias("other"))


@query(f"{G} SELECT * FROM iv")
def g5_involves_edges(spark, d):
    _, _, con, _, ev, _ = _graph(spark, d)
    return graph.involves_edges(ev, con)


@query(f"{G} SELECT topic, call_id, 1 AS weight, edge_time FROM tp")
def g6_topic_edges(spark, d):
    return _graph(spark, d)[5]


def _whole(spark, d):
    calls, seg, con, sv, ev, tp = _graph(spark, d)
    edges = graph.graph_edges(graph.talked_edges(seg, calls, sv), graph.involves_edges(ev, con), tp, con)
    return graph.graph_slice(graph.graph_nodes(con, ev, tp), edges, "2024-01-03", "2024-01-20")


SLICED = "rg AS (SELECT * FROM ed WHERE edge_time IS NULL OR (edge_time >= TIMESTAMP '2024-01-03' AND edge_time < TIMESTAMP '2024-01-20')), dg AS (SELECT node, 2 * count(*) AS deg FROM (SELECT src AS node FROM rg UNION ALL SELECT dst FROM rg) GROUP BY 1), kept AS (SELECT nd.*, coalesce(deg, 0) AS deg FROM nd LEFT JOIN dg USING (node) WHERE deg > 0 OR type = 'me')"


@query(f"{G}, {SLICED} SELECT * FROM kept")
def g7_graph_slice_nodes(spark, d):
    return _whole(spark, d)[0].select("node", "type", "label", "deg")


@query(f"{G}, {SLICED} SELECT * FROM rg WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def g7_graph_slice_edges(spark, d):
    return _whole(spark, d)[1]


def _json(*fields: tuple[str, str]) -> str:
    """SQL of a JSON object under data without its null fields, the first of which is never null."""
    first, *rest = [f"""'"{name}":' || CAST(to_json({x}) AS VARCHAR)""" for name, x in fields]
    return "'{\"data\":{' || " + first + "".join(f" || coalesce(',' || {x}, '')" for x in rest) + " || '}}'"


@query(f"""{G}, {SLICED} SELECT {_json(("id", "node"), ("label", "label"), ("type", "type"), ("deg", "deg"))} AS element FROM kept
UNION ALL SELECT {_json(("source", "src"), ("target", "dst"), ("kind", "kind"), ("weight", "weight"), ("time", "CAST(edge_time AS VARCHAR)"), ("call_id", "call_id"))} FROM rg WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)""")
def s9_graph_elements(spark, d):
    return graph.graph_elements(*_whole(spark, d))


@query(f"{G} SELECT call_id, no, title, event_time, filename FROM ev LEFT JOIN calls ON calls.id = ev.call_id ORDER BY event_time DESC NULLS LAST, call_id DESC, no LIMIT 200")
def g8_event_timeline(spark, d):
    calls, _, _, _, ev, _ = _graph(spark, d)
    return graph.event_timeline(ev, calls)


# -- parts of names and lines of text -------------------------------------------------------------


def _stamped(spark, d, fmt, head="", tail=""):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit(head), F.date_format("ts", fmt), F.lit(tail)).alias("s"), "user_id")


def _ntz(c):
    return c.cast("timestamp_ntz")


@query("SELECT event_id AS id, '13' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS squashed FROM events")
def t1_squash_spaced_digits(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.concat(F.lit("13"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    spaced = F.concat_ws(" ", F.substring(n, 1, 3), F.substring(n, 4, 4), F.substring(n, 8, 4))
    return e.select(F.col("event_id").alias("id"), tx.squash_spaced_digits(spaced).alias("squashed"))


@query("SELECT event_id AS id, date_trunc('second', ts) AS t FROM events")
def t2_parse_stamp_pair(spark, d):
    return _stamped(spark, d, "HHmmss_yyMMdd", "Calling_").select("id", _ntz(tx.parse_stamp_pair(F.col("s"))).alias("t"))


@query("SELECT event_id AS id, date_trunc('second', ts) AS t FROM events")
def t3_parse_cn_date(spark, d):
    return _stamped(spark, d, "yyyy年M月d日 HH.mm.ss", "通话 ").select("id", _ntz(tx.parse_cn_date(F.col("s"))).alias("t"))


@query("SELECT event_id AS id, date_trunc('second', ts) AS t FROM events")
def t5_parse_date_time(spark, d):
    return _stamped(spark, d, "yyyy-MM-dd_HH.mm.ss", "REC_").select("id", _ntz(tx.parse_date_time(F.col("s"))).alias("t"))


@query("SELECT event_id AS id, CAST(13800000000 + user_id AS VARCHAR) AS phone, CASE WHEN user_id % 2 = 0 THEN '95588' ELSE '4001234567' END AS hotline FROM events")
def t6_t7_phone_and_hotline(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.concat(F.lit("010-62345678 +86 "), (F.col("user_id") + 13800000000).cast("string"))
    h = F.when(F.col("user_id") % 2 == 0, F.lit("desk 95588 1")).otherwise(F.lit("95588 or 4001234567"))
    return e.select(F.col("event_id").alias("id"), tx.extract_phone(n).alias("phone"), tx.extract_hotline(h).alias("hotline"))


@query("SELECT event_id AS id, '张伟' || CASE WHEN user_id % 2 = 0 THEN '明' ELSE '' END AS name, 'user_' || user_id AS pattern_name FROM events")
def t8_t9_names(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = F.concat(F.lit("录音张伟"), F.when(F.col("user_id") % 2 == 0, "明").otherwise(""), F.lit(" x user_"), F.col("user_id").cast("string"), F.lit("-"))
    return e.select(F.col("event_id").alias("id"), tx.cjk_name(s).alias("name"), tx.apply_name_patterns(s, ["(", r"(?P<name>user_\d+)-"])["name"].alias("pattern_name"))


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'A' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS label, CASE WHEN user_id % 4 = 0 THEN 'shared_line' ELSE 'person' END AS kind FROM events")
def t12_t13_lines_and_seats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    said = F.when(F.col("user_id") % 3 == 0, "我是应该客服").otherwise(F.concat(F.lit("您好，工号是A"), F.lpad(F.col("user_id").cast("string"), 4, "0")))
    name = F.when(F.col("user_id") % 4 == 0, "某某银行").otherwise("张伟")
    return e.select(F.col("event_id").alias("id"), tx.extract_seat_label(said).alias("label"), tx.classify_line(name, F.lit(None).cast("string")).alias("kind"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def t14_strip_tags(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", tx.strip_tags(F.concat(F.lit("<|en|><|NEUTRAL|> "), "text")).alias("text"))


@query()
def s1_list_recordings(spark, d):
    from callweave.sources.recordings import list_recordings

    files = list_recordings(spark, d, [".parquet"])
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
