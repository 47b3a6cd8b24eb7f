"""Statistics, queues and search as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import fixtures as fx
from callweave.operators import stats
from callweave.registry import query

W = fx.with_tables()
SEC = "CAST(duration_sec AS DECIMAL(18,4))"
LABEL = "coalesce(nullif(contact_hint, ''), nullif(phone, ''))"
MINUTES = f"round(CAST(sum({SEC}) AS DOUBLE) / 60, 1)"


@query(f"""{W} SELECT * FROM (SELECT count(*) FILTER (dup_of IS NULL) AS total_calls, count(*) FILTER (dup_of IS NULL AND status IN ('transcribed','analyzed')) AS done,
 round(CAST(coalesce(sum({SEC}) FILTER (dup_of IS NULL), 0) AS DOUBLE) / 3600, 2) AS hours, min(call_time) FILTER (dup_of IS NULL) AS first_call, max(call_time) FILTER (dup_of IS NULL) AS last_call,
 count(*) FILTER (dup_of IS NOT NULL) AS dup_copies, round(CAST(coalesce(sum({SEC}) FILTER (dup_of IS NOT NULL), 0) AS DOUBLE) / 3600, 2) AS dup_hours,
 CAST(coalesce(sum(size_bytes) FILTER (dup_of IS NOT NULL), 0) AS BIGINT) AS dup_bytes FROM calls),
 (SELECT count(*) FILTER (coalesce(kind, 'person') <> 'org') AS contacts, count(*) FILTER (kind = 'org') AS orgs FROM contacts)""")
def q1_overview(spark, d):
    return stats.overview(fx.calls(spark, d), fx.contacts(spark, d))


def _timeline(bucket, fmt):
    @query(f"{W} SELECT strftime(call_time, '{fmt}') AS bucket, count(*) AS calls, {MINUTES} AS minutes FROM calls WHERE call_time IS NOT NULL AND dup_of IS NULL GROUP BY 1")
    def f(spark, d):
        return stats.timeline(fx.calls(spark, d), bucket)

    return f


def _named(name, make):
    """Registers what make() registers under another name."""
    from callweave.registry import ORACLES, QUERIES

    f = make()
    QUERIES[name] = QUERIES.pop(f.__name__)
    if f.__name__ in ORACLES:
        ORACLES[name] = ORACLES.pop(f.__name__)


for _b, _f in {"day": "%Y-%m-%d", "week": "%Y-W%W", "month": "%Y-%m", "year": "%Y"}.items():
    _named(f"q2_timeline_{_b}", lambda _b=_b, _f=_f: _timeline(_b, _f))


@query(f"""{W}, n AS (SELECT dayofweek(call_time) AS weekday, hour(call_time) AS hour, count(*) AS n FROM calls WHERE call_time IS NOT NULL AND dup_of IS NULL GROUP BY 1, 2)
SELECT CAST(i // 24 AS INT) AS weekday, CAST(i % 24 AS INT) AS hour, coalesce(n, 0) AS n FROM range(168) r(i) LEFT JOIN n ON n.weekday = i // 24 AND n.hour = i % 24""")
def q3_heatmap(spark, d):
    return stats.heatmap(fx.calls(spark, d))


@query(f"""{W} SELECT coalesce({LABEL}, '未知') AS name, count(*) AS calls, round(CAST(coalesce(sum({SEC}), 0) AS DOUBLE) / 60, 1) AS minutes, min(call_time) AS first, max(call_time) AS last
FROM calls WHERE dup_of IS NULL GROUP BY 1 ORDER BY calls DESC, name LIMIT 30""")
def q4_top_contacts(spark, d):
    return stats.top_contacts(fx.calls(spark, d))


@query(f"""{W} SELECT strftime(c.call_time, '%Y-%m') AS bucket, count(DISTINCT c.id) AS calls FROM segments s JOIN calls c ON c.id = s.call_id
WHERE s.who = 'other' AND s.contact_id = 3 AND c.dup_of IS NULL AND call_time IS NOT NULL GROUP BY 1""")
def q5_contact_timeline(spark, d):
    return stats.contact_timeline(fx.segments(spark, d), fx.calls(spark, d), 3)


_CASE = " ".join(f"WHEN duration_sec < {e} THEN {i}" for i, (e, _) in enumerate(stats.BINS))
_BINS = ", ".join(f"({i}, '{x}')" for i, (_, x) in enumerate(stats.BINS))


@query(f"""{W}, n AS (SELECT CASE {_CASE} END AS no, count(*) AS n FROM calls WHERE duration_sec IS NOT NULL AND dup_of IS NULL GROUP BY 1), b(no, label) AS (VALUES {_BINS})
SELECT b.no, label, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (no)""")
def q6_duration_histogram(spark, d):
    return stats.duration_histogram(fx.calls(spark, d))


def _sources(spark):
    return spark.range(5).select("id", F.concat(F.lit("source "), F.col("id").cast("string")).alias("name"))


@query(f"""{W}, n AS (SELECT source_id, count(*) AS n_calls, round(CAST(sum(coalesce({SEC}, 0)) AS DOUBLE) / 3600, 2) AS hours, count(*) FILTER (status IN ('transcribed','analyzed')) AS n_done,
 count(*) FILTER (status = 'error') AS n_err, count(*) FILTER (duration_sec IS NULL) AS n_nodur FROM calls GROUP BY 1)
SELECT i AS id, 'source ' || i AS name, hours, coalesce(n_calls, 0) AS n_calls, coalesce(n_done, 0) AS n_done, coalesce(n_err, 0) AS n_err, coalesce(n_nodur, 0) AS n_nodur FROM range(5) r(i) LEFT JOIN n ON source_id = i""")
def q7_source_stats(spark, d):
    return stats.source_stats(_sources(spark), fx.calls(spark, d))


@query(f"{W} SELECT source_id, status, count(*) AS n FROM calls GROUP BY ALL")
def q8_status_counts(spark, d):
    return stats.status_counts(fx.calls(spark, d), by_source=True)


@query(f"{W} SELECT CASE WHEN dup_of IS NULL THEN status ELSE 'copy' END AS status, count(*) AS n FROM calls GROUP BY 1")
def q8_status_counts_live(spark, d):
    return stats.status_counts(fx.calls(spark, d), live_only=True)


def _search(where, tail):
    return f"""{W}, hit AS (SELECT DISTINCT c.id FROM calls c LEFT JOIN segments s ON s.call_id = c.id LEFT JOIN contacts ct ON ct.id = s.contact_id WHERE {where})
SELECT c.id, filename, contact_hint, phone, call_time, duration_sec, status, (SELECT string_agg(DISTINCT ct.name, ',' ORDER BY ct.name) FROM segments s JOIN contacts ct ON ct.id = s.contact_id WHERE s.call_id = c.id AND s.who = 'other') AS contact,
 (SELECT count(*) FROM hit) AS total FROM calls c JOIN hit USING (id) ORDER BY call_time DESC NULLS LAST, id DESC {tail}"""


@query(_search("dup_of IS NULL AND (c.filename ILIKE '%the%' OR c.summary ILIKE '%the%' OR s.text_zh ILIKE '%the%') AND (c.contact_hint ILIKE '%contact_1%' OR c.phone ILIKE '%contact_1%' OR ct.name ILIKE '%contact_1%')", "LIMIT 25"))
def q9_search_calls(spark, d):
    return stats.search_calls(fx.calls(spark, d), fx.segments(spark, d), fx.contacts(spark, d), q="the", contact="contact_1")


@query(_search("call_time >= TIMESTAMP '2024-01-01' AND call_time < TIMESTAMP '2024-01-21' AND status IN ('analyzed') AND s.who = 'other'", "LIMIT 5 OFFSET 5"))
def q9_search_calls_dated(spark, d):
    return stats.search_calls(fx.calls(spark, d), fx.segments(spark, d), fx.contacts(spark, d), who="other", date_from="2024-01-01", date_to="2024-01-20", status="analyzed", dup="all", page=2, size=5)


@query(f"""{W}, x AS (SELECT call_id, string_agg(idx || ':' || who || ':' || coalesce(name, '-') || ':' || text_zh, '|' ORDER BY idx, s.id) AS t FROM segments s LEFT JOIN contacts c ON c.id = s.contact_id GROUP BY 1)
SELECT c.id, status, t FROM calls c LEFT JOIN x ON call_id = c.id""")
def q10_call_detail(spark, d):
    rows = stats.call_detail(fx.calls(spark, d), fx.segments(spark, d), fx.contacts(spark, d))
    line = F.transform("segments", lambda s: F.concat_ws(":", s["idx"].cast("string"), s["who"], F.coalesce(s["contact_name"], F.lit("-")), s["text_zh"]))
    return rows.select("id", "status", F.array_join(line, "|").alias("t"))


@query(f"""{W} SELECT c.id, c.name, c.phone, c.n_calls, count(s.id) AS n_segments FROM contacts c LEFT JOIN segments s ON s.contact_id = c.id AND s.who = 'other'
WHERE c.name ILIKE '%contact_%' OR c.phone ILIKE '%contact_%' GROUP BY ALL""")
def q11_search_contacts(spark, d):
    return stats.search_contacts(fx.contacts(spark, d), fx.segments(spark, d), "contact_")


@query(f"""{W} SELECT 'status:' || status AS item, CAST(count(*) AS DOUBLE) AS n FROM calls GROUP BY 1 UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'hours', round(CAST(sum({SEC}) AS DOUBLE) / 3600, 2) FROM calls
UNION ALL SELECT 'summaries', count(summary) FROM calls UNION ALL SELECT 'segments', count(*) FROM segments UNION ALL SELECT 'me_segments', count(*) FILTER (who = 'me') FROM segments UNION ALL SELECT 'contacts', count(*) FROM contacts""")
def q12_archive_report(spark, d):
    return stats.archive_report(fx.calls(spark, d), fx.segments(spark, d), fx.contacts(spark, d))


@query(f"""{W} SELECT count(*) FILTER (dup_of IS NULL AND status IN ('pending','normalized')) AS pending_transcribe, count(*) FILTER (dup_of IS NULL AND status = 'transcribed' AND summary IS NULL) AS pending_summarize, count(*) AS pending_dedup FROM calls""")
def q13_queue_depths(spark, d):
    return stats.queue_depths(fx.calls(spark, d))


@query(f"{W} SELECT id FROM calls WHERE dup_of IS NULL AND status IN ('transcribed','analyzed') AND wav_path IS NOT NULL AND id % 7 <> 0")
def q14_pending_refine(spark, d):
    calls = fx.calls(spark, d)
    return stats.pending_refine(calls, calls.where("id % 7 = 0").select(F.col("id").alias("call_id"), F.lit("qwen3-asr").alias("engine")))


@query(f"""{W}, v AS (SELECT call_id, who, CASE WHEN id % 3 > 0 THEN contact_id END AS contact_id FROM voices WHERE id % 4 > 0), c AS (SELECT *, CASE WHEN id % 2 = 0 THEN '' END AS speaker_map FROM calls WHERE dup_of IS NULL)
SELECT id FROM c WHERE status IN ('transcribed','analyzed') AND speaker_map IS NULL AND id IN (SELECT call_id FROM v) UNION SELECT id FROM c WHERE id IN (SELECT call_id FROM v WHERE who = 'other' AND contact_id IS NULL)""")
def q15_pending_align(spark, d):
    calls = fx.calls(spark, d).withColumn("speaker_map", F.when(F.col("id") % 2 == 0, F.lit("")))
    v = fx.voices(spark, d).withColumns({"contact_id": F.when(F.col("id") % 3 > 0, F.col("contact_id")), "embedding": F.when(F.col("id") % 4 > 0, F.col("embedding"))})
    return stats.pending_align(calls, v)


@query(f"""{W} SELECT count(*) AS n_shared FROM calls WHERE dup_of IS NULL AND (regexp_matches(phone, '^(?:95\\d{{2,4}}|1[0123]\\d{{3,4}}|[48]00\\d{{7,9}})$') OR phone LIKE '%95588' OR phone LIKE '%10086' OR phone LIKE '%10010')""")
def q16_line_preview(spark, d):
    return stats.line_preview(fx.calls(spark, d))
