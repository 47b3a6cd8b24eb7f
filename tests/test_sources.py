import datetime as dt
import json
import struct

from pyspark.sql import functions as F

from callweave.plans import chain
from callweave.sources import recordings as rec
from callweave.streaming.scan import stream_scan


def wav(seconds):
    data = bytes(int(16000 * seconds) * 2)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def tree(root):
    for p, content in {"a/x.WAV": wav(1.5), "a/y.txt": b"t", "skip/z.wav": b"1", "~t/z.wav": b"1", "b/_h.wav": b"1", "b/empty.wav": b"", "b/w.m4a": b"22"}.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)


def test_listing_and_probe(spark, tmp_path):
    tree(tmp_path)
    got = rec.list_recordings(spark, str(tmp_path), exclude_dirs=["SKIP"])
    assert [r.path.rsplit("/", 2)[1:] for r in got.collect()] == [["a", "x.WAV"], ["b", "w.m4a"]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert files.where("path like '%x.WAV'").select(rec.wav_seconds(F.col("content")).alias("s")).first().s == 1.5
    keys = rec.sampled_fingerprint(files, files.where("path like '%.m4a'")).collect()
    assert len(keys) == 1 and len(keys[0].probe_key) == 64


def test_fingerprint_reads_head_and_tail(spark):
    n = 3 * rec.SLICE
    a, b, c = bytes(n), bytes(n - 1) + b"x", bytes(n // 2) + b"x" + bytes(n - n // 2 - 1)
    df = spark.createDataFrame([(p, n, x) for p, x in (("a", a), ("b", b), ("c", c))], "path string, length long, content binary")
    k = {r.path: r.probe_key for r in rec.sampled_fingerprint(df, df).collect()}
    assert k["a"] == k["c"] != k["b"]


def test_refine_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps({"call_id": 1, "seg_id": 2, "text": "t", "words": [{"w": "a", "s": 1, "e": 2}]}), "{broken", json.dumps({"call_id": 1, "seg_id": 3, "error": "oom"})]))
    ok, n = rec.read_refine_results(spark, str(tmp_path))
    assert ok.count() == 2 and tuple(n.first()) == (3, 1, 1)


CALLS = "id long, path string, filename string, contact_hint string, phone string, call_time timestamp, duration_sec double, size_bytes long, status string, error string, dup_of long, dup_reason string, source_id long, line_kind string, speaker_map string, wav_path string, summary string, analysis string"


def test_streamed_scan_feeds_the_batch_one(spark, tmp_path):
    tree(tmp_path / "in")
    calls, seen = spark.createDataFrame([], CALLS), []

    def handle(batch, no):
        seen.append({r.action: r.n for r in rec.scan_counts(rec.incremental_scan(batch, calls, 1)).collect()})

    q = stream_scan(spark, str(tmp_path / "in"), str(tmp_path / "ck"), handle, exclude_dirs=["skip"])
    q.awaitTermination(120)
    assert seen == [{"added": 2}]


def test_whole_chain(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"/r/{i}.wav", f"Ann {i}_20240101_1000{i:02d}.wav", "Ann", "13800138000", t0, 60.0 + 10 * i, 100 + i, "transcribed", None, None, None, 1, None, None, f"/w/{i}", None, None) for i in range(6)]
    calls = spark.createDataFrame(rows, CALLS)
    vec = lambda me: [1.0, 0.0, 0.1] if me else [0.0, 1.0, 0.1]
    seg = spark.createDataFrame([(c * 10 + k, c, k, str(k % 2), "unknown", None, None, k * 1000, k * 1000 + 900, "hello", vec(k % 2 == 0)) for c in range(6) for k in range(4)], "id long, call_id long, idx int, spk_local string, who string, contact_id long, contact_conf double, start_ms long, end_ms long, text_zh string, embedding array<double>")
    contacts = spark.createDataFrame([(1, "Ann", "13800138000", None, None, None, 0)], "id long, name string, phone string, note string, kind string, parent_id long, n_calls long")
    prints = spark.createDataFrame([(1, vec(False), 0)], "contact_id long, embedding array<double>, source_segment_id long")
    listing = spark.createDataFrame([("/r/9.wav", t0, 5)], "path string, modificationTime timestamp, length long")
    t = chain.run_chain({"calls": calls, "segments": seg, "contacts": contacts, "voiceprints": prints, "me": spark.createDataFrame([(vec(True), 5)], "mean_embedding array<double>, n_samples long")}, listing)
    assert t["calls"].count() == 7
    assert {(r.who, r.contact_id) for r in t["segments"].where("spk_local = '1'").collect()} == {("other", 1)}
    assert t["edges"].where("kind = 'talked'").first().weight == 12


def test_fingerprint_query_takes_every_file(spark, tmp_path):
    import hashlib

    from callweave.registry import QUERIES
    from callweave.plans import queries  # noqa: F401  registers

    texts = ["", "abc", "é" * rec.SLICE, "x" * (rec.SLICE + 1), "ab" * rec.SLICE + "tail", "head" + "é" * 2 * rec.SLICE]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: r.probe_key for r in QUERIES["s5_sampled_fingerprint"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = t.encode()
        assert got[i] == hashlib.sha256(str(len(b)).encode() + b[: rec.SLICE] + (b[-rec.SLICE :] if len(b) > 2 * rec.SLICE else b"")).hexdigest(), i
    assert len(got) == len(texts)


def test_chain_with_a_shared_line_keeps_columns_and_voiceprints(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"/r/{i}.wav", f"x{i}.wav", "line" if i < 8 else "Ann", "95588" if i < 8 else "13800138000", t0 + dt.timedelta(hours=i), 60.0 + 10 * i, 100 + i, "transcribed", None, None, None, 1, None, None, f"/w/{i}", None, None) for i in range(10)]
    vec = lambda c, k: [1.0, 0, 0, 0] if k % 2 == 0 else [0, 1.0, 0, 0] if c >= 8 else [0, 0, 1.0, 0] if c % 2 else [0, 0, 0, 1.0]
    seg = [(c * 10 + k, c, k, str(k % 2), "unknown", None, None, k * 1000, k * 1000 + 900, "hello", [float(x) for x in vec(c, k)]) for c in range(10) for k in range(4)]
    seg = spark.createDataFrame(seg, "id long, call_id long, idx int, spk_local string, who string, contact_id long, contact_conf double, start_ms long, end_ms long, text_zh string, embedding array<double>")
    contacts = spark.createDataFrame([(1, "Ann", "13800138000", "a note", None, None, 0), (2, "line", "95588", None, "org", None, 0)], "id long, name string, phone string, note string, kind string, parent_id long, n_calls long")
    prints = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0], 0)], "contact_id long, embedding array<double>, source_segment_id long")
    me = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], 5)], "mean_embedding array<double>, n_samples long")
    listing = spark.createDataFrame([("/r/0.wav", t0, 100)], "path string, modificationTime timestamp, length long")
    t = chain.run_chain({"calls": spark.createDataFrame(rows, CALLS), "segments": seg, "contacts": contacts, "voiceprints": prints, "me": me}, listing)
    got = {r.name: r for r in t["contacts"].collect()}
    assert set(got) == {"Ann", "line", "line·A", "line·B"} and (got["Ann"].phone, got["Ann"].note, got["Ann"].n_calls) == ("13800138000", "a note", 2)
    assert got["line·A"].parent_id == got["line·B"].parent_id == 2 and got["line·A"].n_calls == got["line·B"].n_calls == 4
    n = {r.contact_id: r["count"] for r in t["voiceprints"].groupBy("contact_id").count().collect()}
    # the line's own voiceprints are those that it grew before it was split; seats have one for each call
    assert n == {1: 5, 2: 8, got["line·A"].id: 4, got["line·B"].id: 4}
