"""Whole chains of stages: from a listing to marked duplicates, from voices to contacts, from answers to a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.components import cut
from callweave.functions.text import apply_summaries, call_fulltext
from callweave.operators import dedup, graph, identity, lines, transcripts
from callweave.operators.stats import live
from callweave.sources.recordings import incremental_scan, refresh_hints

Tables = dict[str, DataFrame]
Probe = Callable[[DataFrame], DataFrame]


def settled(t: Tables, *names: str) -> Tables:
    """The tables with some of them written and read back, so that the next stage's plan starts there."""
    return t | {k: cut(t[k]) for k in names}


def scan_and_dedup(t: Tables, listing: DataFrame, source_id: int | None = None, probe: Probe | None = None) -> Tables:
    """New and changed files become pending calls with parsed names; duplicates are marked.

    ``probe`` gives the fingerprints (path, probe_key) of listed files (path, length, modificationTime):
    those of calls that share size and duration are asked for, unless they have one of their present size.
    """
    scanned = incremental_scan(listing, t["calls"], source_id)
    if "probe_key" in scanned.columns:
        scanned = scanned.withColumn("probe_key", F.when(F.col("action") != "updated", F.col("probe_key")))
    scanned = scanned.drop("mtime", "action")
    scanned = scanned.withColumns({"filename": F.coalesce("filename", F.element_at(F.split("path", "/"), -1)), "id": F.coalesce("id", F.xxhash64("path"))})
    calls = cut(dedup.classify_calls(refresh_hints(scanned).drop("hints_changed")).drop("line_changed"))
    if probe:
        if "probe_key" not in calls.columns:
            calls = calls.withColumn("probe_key", F.lit(None).cast("string"))
        asked = dedup.exact_candidates(dedup.clear_auto_marks(dedup.assign_audio_key(calls))).where("probe_key is null").select("path")
        keys = probe(listing.join(asked, "path", "left_semi")).select(F.col("path").alias("_path"), F.col("probe_key").alias("_key"))
        calls = cut(calls.join(keys, calls["path"] == keys["_path"], "left").withColumn("probe_key", F.coalesce("probe_key", "_key")).drop("_path", "_key"))
    return t | {"calls": dedup.mark_duplicates(calls, call_fulltext(calls, t["segments"]))}


def refine(t: Tables, results: DataFrame) -> Tables:
    """Refined texts and times of whole calls, their full texts, and one output row for each call and engine."""
    last = cut(transcripts.latest_complete(results, t["segments"]))
    segments = transcripts.fold_refined(t["segments"], last)
    new = transcripts.outputs_of(last)
    outputs = transcripts.upsert_outputs(t["outputs"], new) if "outputs" in t else new
    return t | {"segments": segments, "outputs": outputs, "calls": transcripts.rebuild_fulltext(t["calls"], segments, last)}


def label_speakers(t: Tables, threshold: float = 0.55) -> Tables:
    """The owner's voice; sides of the segments of calls that have no speaker map yet, and their maps."""
    centroids = cut(identity.speaker_centroids(t["segments"]))
    me = t["me"] if "me" in t else cut(identity.bootstrap_me(centroids, threshold))
    labels = cut(identity.assign_me_other(centroids, me, t["calls"], threshold))
    seg = t["segments"].join(labels.withColumnRenamed("who", "_who"), ["call_id", "spk_local"], "left").withColumn("who", F.coalesce("_who", "who")).drop("_who")
    maps = identity.speaker_maps(labels).select(F.col("call_id").alias("_call"), F.to_json("speaker_map").alias("_map"))
    calls = t["calls"].join(maps, t["calls"]["id"] == maps["_call"], "left").withColumn("speaker_map", F.coalesce("speaker_map", "_map")).drop("_call", "_map")
    return t | {"me": me, "calls": calls, "segments": identity.inherit_nearest_speaker(seg)}


def seed(t: Tables, extra_names: list[str] | None = None) -> Tables:
    """Contacts named by their number take a label that calls know; labels and numbers without a contact get one."""
    contacts, calls = t["contacts"], t["calls"]
    names = identity.renamed_contacts(calls, contacts).select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    contacts = cut(contacts.join(names, contacts["id"] == names["_id"], "left").withColumn("name", F.coalesce("_name", "name")).select(contacts.columns))
    new = identity.seed_contacts(calls, contacts, extra_names).withColumn("id", identity.fresh_id(F.col("name")))
    return t | {"contacts": contacts.unionByName(new, allowMissingColumns=True)}


def find_contacts(t: Tables, threshold: float = 0.55) -> Tables:
    """Segments of the other side get contacts, by voice, file name and number; new voices get new ones; voiceprints grow."""
    seg, calls, contacts = cut(identity.flag_me_segments(t["segments"], t["me"], open_only=True)), t["calls"], t["contacts"]
    voices = cut(identity.contact_centroids(t["voiceprints"]))
    matches = cut(identity.match_contacts(seg, voices, threshold))
    plain = identity.resolve_contact(seg, matches, calls, contacts, by_phone=True).select("id", F.col("contact_id").alias("org_id"))
    lines_of = contacts.where("kind = 'org'").select(F.col("id").alias("org_id"))
    seats = contacts.where("kind = 'seat'").select(F.col("parent_id").alias("org_id"), F.col("id").alias("seat_id")).join(voices.select(F.col("contact_id").alias("seat_id"), "mean"), "seat_id")
    taken = identity_seats(seg, plain.join(lines_of, "org_id", "left_semi"), seats)
    found = cut(identity.resolve_contact(seg, matches, calls, contacts, taken, by_phone=True).select(F.col("id").alias("_id"), F.col("contact_id").alias("_contact"), F.col("conf").alias("_conf")))
    old = F.col("contact_conf") if "contact_conf" in seg.columns else F.lit(None).cast("double")
    seg = seg.join(found, seg["id"] == found["_id"], "left").withColumns({"contact_conf": F.coalesce("_conf", old), "contact_id": F.coalesce("_contact", "contact_id")}).drop("_id", "_contact", "_conf")
    hint = F.coalesce(F.nullif("contact_hint", F.lit("")), F.nullif("phone", F.lit("")))
    unhinted = live(calls).where(hint.isNull()).select(F.col("id").alias("call_id"))
    seg = cut(seg)
    new = cut(identity.new_voice_contacts(seg.where("who = 'other' and contact_id is null and embedding is not null").join(unhinted, "call_id", "left_semi"), threshold))
    seg, contacts, prints = identity.add_new_voices(new, seg, contacts, t["voiceprints"])
    seg, prints = cut(seg), cut(prints)
    prints = prints.unionByName(identity.grow_voiceprints(seg, prints), allowMissingColumns=True)
    return t | {"segments": identity.inherit_dominant_contact(seg), "contacts": contacts, "voiceprints": prints}


def identity_seats(segments: DataFrame, orgs: DataFrame, seats: DataFrame) -> DataFrame:
    """(id, seat_id) of segments that would go to an organisation (id, org_id) and have the voice of one of its seats."""
    rows = segments.select("id", "embedding").join(orgs, "id")
    return cut(lines.seat_for(rows, seats))


def merge_people(t: Tables, same: float = 0.8) -> Tables:
    """Contacts of one phone, then those of one voice, become one; all count their calls."""
    for merges in (identity.merge_same_phone, lambda c: identity.merge_same_voice(c, t["voiceprints"], same)):
        step = cut(merges(t["contacts"]))
        contacts, moved = identity.apply_merges(t["contacts"], step, {"segments": t["segments"], "voiceprints": t["voiceprints"]})
        t = settled(t | moved | {"contacts": contacts}, "segments", "voiceprints", "contacts")
    n = identity.contact_call_counts(t["contacts"], t["segments"]).select("id", F.col("n_calls").alias("_n"))
    kind = t["contacts"].schema["n_calls"].dataType
    return t | {"contacts": t["contacts"].join(n, "id").withColumn("n_calls", F.col("_n").cast(kind)).select(t["contacts"].columns)}


def align(t: Tables, threshold: float = 0.55, same: float = 0.8, extra_names: list[str] | None = None) -> Tables:
    """Speakers are labelled, contacts seeded, found and grown, and those of one person merged."""
    t = settled(label_speakers(t, threshold), "calls", "segments")
    t = settled(seed(t, extra_names), "contacts")
    return merge_people(settled(find_contacts(t, threshold), "segments", "contacts", "voiceprints"), same)


def split_lines(t: Tables) -> Tables:
    """Voices on shared lines become seats."""
    centroids = lines.other_centroids(t["segments"])
    members = lines.line_voices(centroids, t["calls"])
    clusters = cut(lines.split_decision(lines.cluster_line(members, t["calls"])))
    orgs = t["contacts"].where("kind = 'seat'").select(F.col("id").alias("seat_id"), "name", F.col("parent_id"))
    seats = orgs.join(t["contacts"].select(F.col("id").alias("parent_id"), F.col("name").alias("contact_hint")), "parent_id")
    voices = identity.contact_centroids(t["voiceprints"]).select(F.col("contact_id").alias("seat_id"), "mean")
    claimed = lines.reuse_seats(clusters, seats.join(voices, "seat_id").select("contact_hint", "seat_id", "mean"))
    named = lines.name_seats(clusters, members, t["segments"], claimed, seats.select("contact_hint", "seat_id", "name"))
    return t | lines.apply_split(clusters, members, named, t["segments"], centroids, t["contacts"], t["voiceprints"])


def relate(t: Tables, responses: DataFrame | None = None) -> Tables:
    """Answers become summaries; nodes and edges are built from calls, contacts and analyses."""
    calls = apply_summaries(t["calls"], responses) if responses is not None else t["calls"]
    service = graph.service_calls(calls, t["segments"])
    events, topics = graph.extract_events(calls, service), graph.topic_edges(calls, service)
    edges = graph.graph_edges(graph.talked_edges(t["segments"], calls, service), graph.involves_edges(events, t["contacts"]), topics, t["contacts"])
    return t | {"calls": calls, "events": events, "nodes": graph.graph_nodes(t["contacts"], events, topics), "edges": edges}


def run_chain(t: Tables, listing: DataFrame, results: DataFrame | None = None, responses: DataFrame | None = None, probe: Probe | None = None, source_id: int | None = None) -> Tables:
    """Scan and dedup before any expensive work, refined text next, then align, lines and graph.

    ``t`` has calls, segments, contacts and voiceprints, and may have the owner's voice (me) and outputs.
    """
    t = settled(scan_and_dedup(t, listing, source_id, probe), "calls")
    if results is not None:
        t = settled(refine(t, results), "calls", "segments", "outputs")
    t = settled(align(t), "segments", "contacts", "voiceprints")
    return relate(settled(split_lines(t), "segments", "contacts", "voiceprints"), responses)
