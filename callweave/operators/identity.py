"""Who is speaking: centroids, the owner's voice, contacts and their merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.cells import near_links, nearest
from callweave.functions.components import components, cut, with_group
from callweave.functions.leaders import BLOCK, followed, joined_up, leaders, sortable, stacked
from callweave.functions.text import classify_line
from callweave.functions.vectors import average_linkage, dot, doubles, means, sums, unit
from callweave.operators.stats import live, recent

#: Contacts up to which their centroids are broadcast as one matrix; beyond, an equi-join over blocks.
FEW_CONTACTS = 100_000
#: Bytes of centroids up to which they are broadcast.
FEW_BYTES = 64 << 20
#: Name of a contact made of a voice, before the id of its first segment, and its note.
NEW_VOICE, NEW_VOICE_NOTE = "未知声纹", "由声纹聚类自动创建"
#: Fixed value: how a note begins that names a contact's other numbers and names.
ALIAS = "同一个人其他号码/称呼: "


def speaker_centroids(segments: DataFrame) -> DataFrame:
    """(call_id, spk_local, mean, n)."""
    return means(segments, ["call_id", "spk_local"])


def diarize(segments: DataFrame, k: int = 2) -> DataFrame:
    """(id, speaker) within each call, in order of idx; -1 without an embedding."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "id"])
        have = pdf["embedding"].notna().to_numpy()
        out = np.full(len(pdf), -1)
        out[have] = average_linkage(np.stack([np.asarray(v, float) for v in pdf["embedding"][have]]), k) if have.any() else []
        return pd.DataFrame({"id": pdf["id"], "speaker": out})

    return segments.select("call_id", "id", "start_ms", doubles(F.col("embedding")).alias("embedding")).groupBy("call_id").applyInPandas(run, "id long, speaker int")


def bootstrap_me(centroids: DataFrame, threshold: float = 0.55, min_calls: int = 5, block: int = BLOCK) -> DataFrame:
    """(mean_embedding, n_samples): the voice of the most calls; no row if that isn't clear.

    In order of call and label, a centroid follows the first leading one that it is near, or leads;
    then clusters whose means are near join, largest first. Both are settled in rounds, so that the
    answer is that of the plain loop on any partitions; no task holds all centroids.
    """
    rows = centroids.select(F.lit(0).alias("all"), F.concat(sortable(F.col("call_id")), F.col("spk_local").cast("string")).alias("first"), "call_id", unit(F.col("mean")).alias("v"))
    rows = cut(rows)
    own = followed(rows, leaders(rows, threshold, "all", "first", "v", block), threshold, "all", "first", "v", best=False, block=block)
    member = cut(rows.join(own.select("first", "leader"), "first"))
    size = member.select("leader", "call_id").distinct().groupBy("leader").agg(F.count("*").alias("size"))
    total = sums(member, ["leader"], "v").join(size, "leader")
    up = joined_up(total.select(F.lit(0).alias("all"), F.col("leader").alias("first"), "size", "total"), threshold, "all", block)
    voice = cut(member.join(up.select(F.col("first").alias("leader"), "to"), "leader").select("to", "call_id", "v"))
    calls = voice.select("to", "call_id").distinct().groupBy("to").agg(F.count("*").alias("n_samples"))
    top = cut(calls.orderBy(F.desc("n_samples"), "to").limit(1))
    mean = means(voice.join(F.broadcast(top), "to"), ["to", "n_samples"], "v").select(F.col("mean").alias("mean_embedding"), "n_samples")
    total = rows.agg(F.count_distinct("call_id").alias("total"))
    return mean.join(total).where((F.col("total") >= min_calls) & (F.col("n_samples") >= F.greatest(F.lit(3), F.floor(F.col("total") * 0.2)))).drop("total")


def update_me(profile: DataFrame, sample: DataFrame) -> DataFrame:
    """The running mean of a profile and one more sample (each one row with mean_embedding)."""
    new = sample.select(unit(F.col("mean_embedding")).alias("v"))
    old = profile.select(unit(F.col("mean_embedding")).alias("o"), "n_samples")
    return old.join(new).select(unit(F.zip_with("o", "v", lambda x, y: x * F.col("n_samples") + y)).alias("mean_embedding"), (F.col("n_samples") + 1).alias("n_samples"))


def assign_me_other(centroids: DataFrame, me: DataFrame, calls: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(call_id, spk_local, who) of calls without a speaker map: the best label is me if near enough."""
    todo = calls.where("speaker_map is null").select(F.col("id").alias("call_id"))
    rows = centroids.join(todo, "call_id", "left_semi").join(F.broadcast(me.select(unit(F.col("mean_embedding")).alias("me"))))
    w = Window.partitionBy("call_id").orderBy(F.desc("sim"), "spk_local")
    top = rows.withColumn("sim", dot(F.col("mean"), F.col("me"))).withColumn("no", F.row_number().over(w)).withColumn("best", F.max("sim").over(Window.partitionBy("call_id")))
    who = F.when(F.col("best") < threshold, "unknown").when(F.col("no") == 1, "me").otherwise("other")
    return top.select("call_id", "spk_local", who.alias("who"))


def speaker_maps(labels: DataFrame) -> DataFrame:
    return labels.groupBy("call_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("spk_local", "who")))).alias("speaker_map"))


def inherit_nearest_speaker(segments: DataFrame) -> DataFrame:
    """segments whose unknown speakers take that of the nearest known start in the call, the earlier of two."""
    known = F.when(F.col("who").isin("me", "other"), F.struct("start_ms", "who"))
    w = Window.partitionBy("call_id").orderBy("start_ms", "id")
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = segments.withColumns({"_b": back, "_a": ahead})
    near = F.when(F.col("_b").isNull() | (F.col("_a")["start_ms"] - F.col("start_ms") < F.col("start_ms") - F.col("_b")["start_ms"]), F.col("_a")["who"]).otherwise(F.col("_b")["who"])
    return rows.withColumn("who", F.when(F.col("who") == "unknown", F.coalesce(near, F.col("who"))).otherwise(F.col("who"))).drop("_a", "_b")


def contact_centroids(voiceprints: DataFrame) -> DataFrame:
    """(contact_id, mean, n)."""
    return means(voiceprints, ["contact_id"])


def seed_contacts(calls: DataFrame, contacts: DataFrame, extra_names: list[str] | None = None, mobile_ends: bool = True) -> DataFrame:
    """New contacts (name, phone, kind) of live calls: no second one for a known name or phone.

    Of several labels of one phone the first by name that isn't the phone itself counts.
    """
    name = F.coalesce("contact_hint", "phone")
    pairs = live(calls).where("contact_hint is not null or phone is not null").select(name.alias("name"), "phone").distinct()
    w = Window.partitionBy(F.coalesce("phone", F.concat(F.lit("name:"), "name"))).orderBy((F.col("name") == F.col("phone")).cast("int"), "name")
    one = pairs.withColumn("no", F.row_number().over(w)).where("no = 1").drop("no")
    by_name = one.withColumn("no", F.row_number().over(Window.partitionBy("name").orderBy(F.col("phone").asc_nulls_last()))).where("no = 1").drop("no")
    fresh = by_name.join(contacts.select("name"), "name", "left_anti").join(contacts.where("phone is not null").select("phone"), "phone", "left_anti")
    return fresh.select("name", "phone", F.when(classify_line(F.col("name"), F.col("phone"), extra_names, mobile_ends) == "shared_line", "org").alias("kind"))


def renamed_contacts(calls: DataFrame, contacts: DataFrame) -> DataFrame:
    """(id, name) of contacts named by their number that calls know by a label nobody bears."""
    labels = live(calls).where("phone is not null and contact_hint is not null and contact_hint <> phone").select("phone", F.col("contact_hint").alias("label")).distinct()
    free = labels.join(contacts.select(F.col("name").alias("label")), "label", "left_anti").groupBy("phone").agg(F.min("label").alias("label"))
    return contacts.where("name = phone").join(free, "phone").select("id", F.col("label").alias("name"))


def flag_me_segments(segments: DataFrame, me: DataFrame, threshold: float = 0.6, open_only: bool = False) -> DataFrame:
    """segments of the other side that have the owner's voice become the owner's; ``open_only``: those without a contact."""
    rows = segments.join(F.broadcast(me.select(unit(F.col("mean_embedding")).alias("_me"))))
    near = (F.col("who") == "other") & (dot(unit(F.col("embedding")), F.col("_me")) > threshold)
    near = near & F.col("contact_id").isNull() if open_only else near
    return rows.withColumn("who", F.when(near, "me").otherwise(F.col("who"))).drop("_me")


def match_contacts(segments: DataFrame, centroids: DataFrame, threshold: float = 0.55, few: int = FEW_CONTACTS) -> DataFrame:
    """(id, contact_id, sim): the nearest contact of segments of the other side without one.

    Up to ``few`` contacts and FEW_BYTES the centroids are multiplied as one matrix that is broadcast.
    Beyond, pivot cells tell which centroids a segment has to meet; the answer is the same.
    """
    rows = segments.where("who = 'other' and contact_id is null and embedding is not null").select("id", unit(F.col("embedding")).alias("v"))
    n, width = centroids.agg(F.count("*"), F.max(F.size("mean"))).first()
    if n > few or n * (width or 0) * 8 > FEW_BYTES:
        return nearest(rows, centroids, threshold, "id", "contact_id").select("id", "contact_id", "sim")
    if n == 0:
        return rows.select("id", F.lit(None).cast("long").alias("contact_id"), F.lit(None).cast("double").alias("sim")).limit(0)
    held = centroids.orderBy("contact_id").select("contact_id", "mean").toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((held["contact_id"].to_numpy(), stacked(held["mean"])))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ids, m = sent.value
                s = stacked(pdf["v"]) @ m.T
                k = s.argmax(1)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "contact_id": ids[k], "sim": s[np.arange(len(k)), k]})

    return rows.mapInPandas(run, "id long, contact_id long, sim double").where(F.col("sim") >= threshold)


def resolve_contact(segments: DataFrame, matches: DataFrame, calls: DataFrame, contacts: DataFrame, seats: DataFrame | None = None, by_phone: bool = False) -> DataFrame:
    """(id, contact_id, conf): the voice's contact unless the file name says another.

    A hinted person beats the voice (0.95), a hinted organisation too (0.7); without a match the
    hint decides (0.9, organisations 0.7). On an organisation a known seat of (id, seat_id) takes
    the segment (0.8 with a voice match, 0.75 without). With ``by_phone`` a segment that neither its
    voice nor its hint gives a contact has the one of its call's number (0.9, organisations 0.7).
    """
    hint = F.coalesce(F.nullif(F.col("contact_hint"), F.lit("")), F.nullif(F.col("phone"), F.lit("")))
    todo = segments.where("who = 'other' and contact_id is null and embedding is not null").select("id", "call_id")
    c = live(calls).select(F.col("id").alias("call_id"), hint.alias("hint"), "phone")
    named = contacts.groupBy("name").agg(F.min_by(F.struct("id", "kind"), "id").alias("h")).select(F.col("name").alias("hint"), F.col("h.id").alias("hint_id"))
    kinds = contacts.select(F.col("id").alias("target"), "kind")
    rows = todo.join(c, "call_id").join(named, "hint", "left").join(matches.select("id", F.col("contact_id").alias("voice"), "sim"), "id", "left")
    if by_phone:
        numbers = contacts.where("phone <> ''").groupBy("phone").agg(F.min("id").alias("phone_id"))
        rows = rows.join(numbers, "phone", "left").withColumn("hint_id", F.coalesce("hint_id", F.when(F.col("voice").isNull() & F.col("hint").isNotNull(), F.col("phone_id"))))
    rows = rows.withColumn("target", F.coalesce("hint_id", "voice")).where("target is not null").join(kinds, "target", "left")
    org = F.coalesce(F.col("kind") == "org", F.lit(False))
    voiced = F.col("voice").isNotNull()
    conf = F.when(voiced & (F.col("hint_id").isNull() | (F.col("hint_id") == F.col("voice"))), F.col("sim")).when(org, 0.7).when(voiced, 0.95).otherwise(0.9)
    if seats is not None:
        rows = rows.join(seats, "id", "left")
    seat = F.when(org, F.col("seat_id")) if seats is not None else F.lit(None).cast("long")
    return rows.select("id", F.coalesce(seat, "target").alias("contact_id"), F.when(seat.isNotNull(), F.when(voiced, 0.8).otherwise(0.75)).otherwise(conf).alias("conf"))


def new_voice_contacts(unmatched: DataFrame, threshold: float = 0.55, block: int = BLOCK) -> DataFrame:
    """(id, first_id, name, conf) of segments that nothing matched: later ones join earlier ones' new contact.

    In order of id a segment goes to the nearest of the new contacts so far, or is the first of one,
    by whose id it is named. A contact's voice is that of its first segment. Settled in rounds: the
    answer is the plain loop's on any partitions.
    """
    rows = cut(unmatched.select(F.lit(0).alias("all"), "id", unit(F.col("embedding")).alias("v")))
    found = followed(rows, leaders(rows, threshold, "all", "id", "v", block), threshold, "all", "id", "v", block=block)
    return found.select("id", F.col("leader").alias("first_id"), F.concat(F.lit(NEW_VOICE), F.col("leader").cast("string")).alias("name"), F.lit(0.7).alias("conf"))


def fresh_id(name: Column) -> Column:
    """An id for a new row: a hash of its name, negative, so that it is none of the ids given so far."""
    return F.xxhash64(name).bitwiseOR(F.lit(-(2**63)))


def add_new_voices(found: DataFrame, segments: DataFrame, contacts: DataFrame, voiceprints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """segments with their new contacts, contacts with a row for each, and voiceprints with its first segment (quality 0.6)."""
    ids = found.select(F.col("id").alias("_id"), fresh_id(F.col("name")).alias("_new"), F.col("conf").alias("_conf"))
    seg = segments.join(ids, segments["id"] == ids["_id"], "left")
    old = F.col("contact_conf") if "contact_conf" in segments.columns else F.lit(None).cast("double")
    seg = seg.withColumns({"contact_conf": F.coalesce("_conf", old), "contact_id": F.coalesce("_new", "contact_id")}).drop("_id", "_new", "_conf")
    firsts = found.where("id = first_id").select("id", "name")
    rows = firsts.join(contacts.select("name"), "name", "left_anti").select(fresh_id(F.col("name")).alias("id"), "name")
    if "note" in contacts.columns:
        rows = rows.withColumn("note", F.lit(NEW_VOICE_NOTE))
    prints = segments.select("id", "call_id", "embedding").join(firsts, "id").join(voiceprints.where("source_segment_id is not null").select(F.col("source_segment_id").alias("id")), "id", "left_anti")
    prints = prints.select(fresh_id(F.col("name")).alias("contact_id"), unit(F.col("embedding")).alias("embedding"), F.col("call_id").alias("source_call_id"), F.col("id").alias("source_segment_id"), F.lit(0.6).alias("quality"))
    return seg, contacts.unionByName(rows, allowMissingColumns=True), voiceprints.unionByName(prints, allowMissingColumns=True)


def grow_voiceprints(segments: DataFrame, voiceprints: DataFrame, cap: int = 8) -> DataFrame:
    """New voiceprints (contact_id, source_segment_id, source_call_id, embedding, quality) up to cap a contact.

    The first ``cap`` segments of a contact are kept within each partition before the shuffle.
    """
    have = voiceprints.groupBy("contact_id").agg(F.count("*").alias("have"))
    used = voiceprints.where("source_segment_id is not null").select(F.col("source_segment_id").alias("id"))
    rows = segments.where("contact_id is not null and embedding is not null").join(used, "id", "left_anti")
    rows = recent(rows.select("contact_id", "id", "call_id", "embedding"), ["contact_id"], [F.col("id").asc()], cap).join(have, "contact_id", "left")
    w = Window.partitionBy("contact_id").orderBy("id")
    return rows.withColumn("no", F.row_number().over(w)).where(F.col("no") <= cap - F.coalesce("have", F.lit(0))).select("contact_id", F.col("id").alias("source_segment_id"), F.col("call_id").alias("source_call_id"), unit(F.col("embedding")).alias("embedding"), F.lit(0.5).alias("quality"))


def inherit_dominant_contact(segments: DataFrame) -> DataFrame:
    """segments where the other side's without contact and embedding take the call's most frequent one."""
    n = segments.where("contact_id is not null").groupBy("call_id", "contact_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("call_id").orderBy(F.desc("n"), "contact_id")
    top = n.withColumn("no", F.row_number().over(w)).where("no = 1").select("call_id", F.col("contact_id").alias("_top"))
    silent = F.col("embedding").isNull() if "embedding" in segments.columns else F.lit(True)
    take = (F.col("who") == "other") & F.col("contact_id").isNull() & silent & F.col("_top").isNotNull()
    old = F.col("contact_conf") if "contact_conf" in segments.columns else F.lit(None).cast("double")
    return segments.join(top, "call_id", "left").withColumns({"contact_conf": F.when(take, 0.6).otherwise(old), "contact_id": F.when(take, F.col("_top")).otherwise(F.col("contact_id"))}).drop("_top")


def contact_call_counts(contacts: DataFrame, segments: DataFrame) -> DataFrame:
    n = segments.groupBy("contact_id").agg(F.count_distinct("call_id").alias("n"))
    return contacts.join(n, contacts["id"] == n["contact_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_calls"))


def _real() -> F.Column:
    return F.coalesce((F.col("name") != "") & ~F.col("name").eqNullSafe(F.col("phone")), F.lit(False))


def merge_same_phone(contacts: DataFrame) -> DataFrame:
    """(drop_id, keep_id) of contacts but seats that share a phone: a real name first, most calls, lowest id."""
    rows = contacts.where("phone is not null and phone <> '' and coalesce(kind, 'person') <> 'seat'")
    w = Window.partitionBy("phone").orderBy(_real().cast("int").desc(), F.coalesce("n_calls", F.lit(0)).desc(), "id")
    return rows.select("id", F.first("id").over(w).alias("keep_id")).where("id <> keep_id").select(F.col("id").alias("drop_id"), "keep_id")


def merge_same_voice(contacts: DataFrame, voiceprints: DataFrame, threshold: float = 0.8, **search: int) -> DataFrame:
    """(drop_id, keep_id) of contacts but seats whose voices are near: real name, most calls, lowest id.

    Order-free: links that connect all near centroids are found through pivot cells, and each group's
    survivor is chosen; centroids are computed anew from the joined voiceprints until nothing is
    near. Every round but the last leaves fewer people, so the rounds end.
    """
    people = cut(contacts.where("coalesce(kind, 'person') <> 'seat'").select("id", "name", "phone", F.coalesce("n_calls", F.lit(0)).alias("n_calls")))
    prints = cut(voiceprints.join(people.select(F.col("id").alias("contact_id")), "contact_id", "left_semi").select("contact_id", "embedding"))
    merged = people.select(F.col("id").alias("drop_id"), F.col("id").alias("keep_id"))
    while True:
        near = cut(near_links(contact_centroids(prints), threshold, "contact_id", **search).where("a is not null").select("a", "b"))
        if near.isEmpty():
            break
        groups = components(near).withColumnRenamed("node", "id")
        best = F.min_by("id", F.struct((~_real()).alias("bare"), (-F.col("n_calls")).alias("few"), "id"))
        kept = with_group(people.join(groups, "id"), ["component"], F.col("id"), to=best)
        step = cut(kept.where("id <> to").select("id", "to"))
        moved = lambda df, c: df.join(step, df[c] == step["id"], "left").withColumn(c, F.coalesce("to", c)).drop("id", "to")  # noqa: B023, E731
        merged, prints = cut(moved(merged, "keep_id")), cut(moved(prints, "contact_id"))
        people = cut(people.join(step.select("id"), "id", "left_anti"))
    return merged.where("drop_id <> keep_id")


def apply_merges(contacts: DataFrame, merges: DataFrame, rows: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Contacts after merging, with the names and phones of the dropped in the survivor's note, and rows repointed.

    A survivor named by its number takes the first alias that isn't a number. The note keeps what
    else stood in it; its aliases are distinct, in order, and aren't the survivor's own name or phone.
    """
    m = merges.select(F.col("drop_id"), F.col("keep_id"))
    tag = F.lit(ALIAS)
    parts = F.filter(F.split(F.coalesce("note", F.lit("")), r" \| "), lambda p: p != "")
    own = F.flatten(F.transform(F.filter(parts, lambda p: p.startswith(ALIAS)), lambda p: F.split(F.replace(p, tag, F.lit("")), " / ")))
    dropped = contacts.join(m, contacts["id"] == m["drop_id"]).groupBy("keep_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("id", F.array_compact(F.array("phone", "name")).alias("a")))).getField("a")).alias("more"))
    kept = contacts.join(m.select(F.col("drop_id").alias("id")), "id", "left_anti").join(dropped, F.col("id") == F.col("keep_id"), "left")
    every = F.filter(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))), lambda a: (a != "") & ~a.eqNullSafe(F.col("name")) & ~a.eqNullSafe(F.col("phone")))
    kept = kept.withColumns({"_plain": F.filter(parts, lambda p: ~p.startswith(ALIAS)), "_alias": every})
    real = F.when(F.col("name") == F.col("phone"), F.get(F.filter("_alias", lambda a: ~a.rlike("^[0-9]+$")), F.lit(0)))
    kept = kept.withColumn("_real", real)
    rest = F.filter("_alias", lambda a: ~a.eqNullSafe(F.col("_real")))
    note = F.array_join(F.concat("_plain", F.when(F.size(rest) > 0, F.array(F.concat(tag, F.array_join(rest, " / ")))).otherwise(F.array().cast("array<string>"))), " | ")
    note = F.when(F.col("more").isNull() & F.col("_real").isNull(), F.col("note")).otherwise(note)
    out = kept.withColumns({"note": note, "name": F.coalesce("_real", "name")}).select(contacts.columns)
    moved = {}
    for k, df in rows.items():
        x = df.join(m, df["contact_id"] == m["drop_id"], "left")
        moved[k] = x.withColumn("contact_id", F.coalesce("keep_id", "contact_id")).select(df.columns)
    return out, moved
