"""Shared lines: one number, several people, told apart by voice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.components import cut, with_group
from callweave.functions.leaders import BLOCK, PIECE, followed, joined_up, leaders, pieces, sortable, stacked
from callweave.functions.text import extract_seat_label
from callweave.functions.vectors import dot, means, norm, sums, unit
from callweave.operators.stats import live, recent

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def other_centroids(segments: DataFrame, min_segs: int = 2) -> DataFrame:
    """(call_id, mean, n) of the other side of calls with enough voiced segments."""
    return means(segments.where("who = 'other'"), ["call_id"]).where(F.col("n") >= min_segs)


def _members(centroids: DataFrame, calls: DataFrame) -> DataFrame:
    c = live(calls).where("contact_hint is not null and contact_hint <> ''").select(F.col("id").alias("call_id"), "contact_hint", "line_kind", "phone")
    return centroids.join(c, "call_id")


def line_voices(centroids: DataFrame, calls: DataFrame, threshold: float = 0.5, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(contact_hint, call_id, cluster, v) of the calls of lines with two or more: which voice of its line a call has.

    In order of call, a centroid follows the nearest leading one of its line, or leads; clusters whose
    means are near join, largest first; then every call goes to the nearest mean. Clusters are numbered
    by their first calls. All in rounds and pieces of bounded size, so that a line of any length isn't
    one task, and the answer doesn't depend on the partitions. The plain loop moves its centres call by
    call: the same clusters where voices are further apart than their calls are.
    """
    rows = cut(_members(centroids, calls).select("contact_hint", "call_id", sortable(F.col("call_id")).alias("first"), unit(F.col("mean")).alias("v")))
    rows = with_group(rows, ["contact_hint"], F.col("call_id"), _n=F.count("*")).where("_n >= 2").drop("_n")
    own = followed(rows, leaders(rows, threshold, "contact_hint", "first", "v", block, piece), threshold, "contact_hint", "first", "v", True, block, piece)
    member = cut(rows.join(own.select("contact_hint", "first", "leader"), ["contact_hint", "first"]))
    total = sums(member, ["contact_hint", "leader"], "v").select("contact_hint", F.col("leader").alias("first"), F.col("n").alias("size"), "total")
    up = joined_up(total, threshold, "contact_hint", block, piece)
    centres = cut(means(member.join(up.select("contact_hint", F.col("first").alias("leader"), "to"), ["contact_hint", "leader"]), ["contact_hint", "to"], "v"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("to")
        m, to = stacked(right["mean"]), right["to"].to_numpy()
        k = np.concatenate([(stacked(left["v"].iloc[i : i + 2048]) @ m.T).argmax(1) for i in range(0, len(left), 2048)]) if len(left) else np.zeros(0, int)
        return left[["contact_hint", "call_id", "v"]].assign(to=to[k])

    a, b = pieces(rows, centres, ["contact_hint"], "call_id", piece)
    near = cut(a.groupBy("contact_hint", "_piece").cogroup(b.groupBy("contact_hint", "_piece")).applyInPandas(nearest, "contact_hint string, call_id long, v array<double>, to string"))
    no = near.groupBy("contact_hint", "to").agg(F.min("call_id").alias("_first"))
    no = no.withColumn("cluster", F.row_number().over(Window.partitionBy("contact_hint").orderBy("_first")) - 1).select("contact_hint", "to", "cluster")
    return cut(near.join(no, ["contact_hint", "to"]).select("contact_hint", "call_id", "cluster", "v"))


def cluster_line(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(contact_hint, line_kind, cluster, n_calls, mean, intra) of each line's voices, from line_voices.

    The line's kind is that of its first call. Intra is the mean cosine of a cluster's calls to its centre.
    """
    centres = sums(members, ["contact_hint", "cluster"], "v")
    length = F.sqrt(dot(F.col("total"), F.col("total")))  # of unit vectors: their mean cosine to the centre is that of the sum over n
    kinds = members.join(calls.select(F.col("id").alias("call_id"), "line_kind"), "call_id").groupBy("contact_hint").agg(F.min_by("line_kind", "call_id").alias("line_kind"))
    rows = centres.select("contact_hint", "cluster", F.col("n").cast("int").alias("n_calls"), unit(F.col("total")).alias("mean"), (length / F.col("n")).alias("intra"))
    return rows.join(kinds, "contact_hint").select("contact_hint", F.coalesce("line_kind", F.lit("person")).alias("line_kind"), "cluster", "n_calls", "mean", "intra")


def cluster_separation(clusters: DataFrame, piece: int = BLOCK) -> DataFrame:
    """(contact_hint, separation): the smallest cosine between two centres; no row for a line of one."""

    def least(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"contact_hint": left["contact_hint"][:0], "separation": pd.Series([], dtype=float)})
        s = stacked(left["mean"]) @ stacked(right["mean"]).T
        s[left["cluster"].to_numpy()[:, None] == right["cluster"].to_numpy()[None]] = np.inf
        return pd.DataFrame({"contact_hint": left["contact_hint"][:1], "separation": [float(s.min())]})

    rows = clusters.select("contact_hint", "cluster", "mean")
    a, b = pieces(rows, rows.toDF(*rows.columns), ["contact_hint"], "cluster", piece)
    # the other side comes in blocks as well, so that a task holds a piece and a block
    b = with_group(b, ["contact_hint"], F.col("cluster"), _n=F.ceil(F.count("*") / F.lit(piece)).cast("int"))
    n = b.select("contact_hint", "_n").distinct()
    b = b.withColumn("_block", F.pmod(F.xxhash64("cluster"), F.col("_n")).cast("int")).drop("_n")
    a = a.join(n, "contact_hint").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    keys = ["contact_hint", "_piece", "_block"]
    every = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(least, "contact_hint string, separation double")
    return every.groupBy("contact_hint").agg(F.min("separation").alias("separation")).where("separation < double('infinity')")


def split_decision(clusters: DataFrame, need_line: int = 2, need_person: int = 3, max_line: float = 0.45, max_person: float = 0.35) -> DataFrame:
    """The large clusters of lines that have two or more, far enough apart."""
    shared = F.col("line_kind") == "shared_line"
    big = clusters.where(F.col("n_calls") >= F.when(shared, need_line).otherwise(need_person))
    sep = cluster_separation(big).withColumnRenamed("separation", "sep")
    return big.join(sep, "contact_hint").where(F.col("sep") < F.when(shared, max_line).otherwise(max_person)).drop("sep")


def cluster_cohesion(clusters: DataFrame) -> DataFrame:
    return clusters.select("contact_hint", "cluster", F.round("intra", 6).alias("intra"))


def reuse_seats(clusters: DataFrame, seats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(contact_hint, cluster, seat_id): the largest cluster first takes the nearest seat that nobody has.

    seats has (contact_hint, seat_id, mean).
    """

    def claim(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        right = right.sort_values("seat_id")
        for r in left.sort_values(["n_calls", "cluster"], ascending=[False, True]).itertuples():
            free = right[~right["seat_id"].isin(taken)]
            if len(free):
                s = np.stack([np.asarray(v, float) for v in free["mean"]]) @ np.asarray(r.mean, float)
                k = int(s.argmax())
                if s[k] >= threshold:
                    taken.add(free["seat_id"].iloc[k])
                    out.append((r.contact_hint, r.cluster, free["seat_id"].iloc[k]))
        return pd.DataFrame(out, columns=["contact_hint", "cluster", "seat_id"])

    return clusters.groupBy("contact_hint").cogroup(seats.groupBy("contact_hint")).applyInPandas(claim, "contact_hint string, cluster int, seat_id long")


def name_seats(clusters: DataFrame, members: DataFrame, segments: DataFrame, claimed: DataFrame, seats: DataFrame) -> DataFrame:
    """(contact_hint, cluster, seat_id, name): line·label from the first sound introduction, else a free letter.

    A claimed seat keeps its name unless that is a letter and a label has been heard. seats has
    (contact_hint, seat_id, name). A label that is the line's name, in it or around it doesn't count.
    """
    calls = members.select("contact_hint", "cluster", "call_id")
    heard = segments.where("who = 'other' and text_zh is not null").join(calls, "call_id").withColumn("label", extract_seat_label(F.col("text_zh"))).where("label is not null")
    heard = heard.where(~(F.contains("label", F.col("contact_hint")) | F.contains(F.col("contact_hint"), F.col("label"))))
    label = heard.groupBy("contact_hint", "cluster").agg(F.min_by("label", F.struct("call_id", "idx")).alias("label"))
    known = seats.select("contact_hint", "seat_id", F.col("name").alias("old"))
    rows = clusters.select("contact_hint", "cluster", "n_calls").join(label, ["contact_hint", "cluster"], "left").join(claimed, ["contact_hint", "cluster"], "left").join(known, ["contact_hint", "seat_id"], "left")
    lettered = F.col("old").rlike("·[A-Z]$")
    used = seats.groupBy("contact_hint").agg(F.collect_set(F.element_at(F.split("name", "·"), -1)).alias("used"))
    rows = rows.join(used, "contact_hint", "left")
    free = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: ~F.coalesce(F.array_contains("used", x), F.lit(False)))
    needs = F.col("seat_id").isNull() & F.col("label").isNull()
    w = Window.partitionBy("contact_hint", needs).orderBy(F.desc("n_calls"), "cluster")
    no = F.row_number().over(w)
    letter = F.coalesce(F.get(free, no - 1), (F.size(F.coalesce("used", F.array().cast("array<string>"))) + no).cast("string"))
    new = F.concat("contact_hint", F.lit("·"), F.coalesce("label", letter))
    name = F.when(F.col("seat_id").isNull() | (lettered & F.col("label").isNotNull()), new).otherwise(F.col("old"))
    return rows.select("contact_hint", "cluster", "seat_id", name.alias("name"))


def apply_split(clusters: DataFrame, members: DataFrame, named: DataFrame, segments: DataFrame, centroids: DataFrame, contacts: DataFrame, voiceprints: DataFrame | None = None) -> dict[str, DataFrame]:
    """contacts with organisations and seats added or marked, segments repointed, and all voiceprints.

    Contacts keep all their columns, and n_calls is counted anew where they have it. An organisation
    that is new gets the phone of its line where clusters have one. Voiceprints of seats that got
    clusters are replaced by the centroids of their calls; all others stay. The id of a new row is a
    hash of its name, negative so that it is none of the ids given so far, and the same in any order.
    """
    fresh_id = F.xxhash64("name").bitwiseOR(F.lit(-(2**63)))
    phones = clusters.select(F.col("contact_hint").alias("name"), F.col("phone") if "phone" in clusters.columns else F.lit(None).cast("string").alias("phone")).groupBy("name").agg(F.min("phone").alias("phone"))
    orgs = named.select(F.col("contact_hint").alias("name")).distinct()
    have = contacts.join(orgs.withColumn("_org", F.lit(1)), "name", "left").withColumn("kind", F.when(F.col("_org") == 1, F.coalesce("kind", F.lit("org"))).otherwise(F.col("kind"))).select(contacts.columns)
    new_orgs = orgs.join(contacts.select("name"), "name", "left_anti").join(phones, "name", "left").select(fresh_id.alias("id"), "name", F.lit("org").alias("kind"), "phone")
    every = have.unionByName(new_orgs if "phone" in contacts.columns else new_orgs.drop("phone"), allowMissingColumns=True)
    fresh = named.where("seat_id is null").join(contacts.select("name"), "name", "left_anti").select("name", "contact_hint").distinct()
    parents = every.select(F.col("name").alias("contact_hint"), F.col("id").alias("parent_id"))
    new_seats = fresh.join(parents, "contact_hint").select(fresh_id.alias("id"), "name", F.lit("seat").alias("kind"), "parent_id")
    renamed = named.where("seat_id is not null").select(F.col("seat_id").alias("id"), F.col("name").alias("_new"))
    out = every.join(renamed, "id", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new").unionByName(new_seats, allowMissingColumns=True)
    ids = out.select("name", F.col("id").alias("to"))
    to = clusters.select("contact_hint", "cluster").join(named, ["contact_hint", "cluster"]).join(ids, "name").select("contact_hint", "cluster", "to")
    calls = cut(members.join(to, ["contact_hint", "cluster"]).select("call_id", "to"))
    moved = segments.join(calls, "call_id", "left")
    hit = F.col("to").isNotNull() & (F.col("who") == "other")
    old = F.col("contact_conf") if "contact_conf" in segments.columns else F.lit(None).cast("double")
    moved = moved.withColumns({"contact_conf": F.when(hit, 0.8).otherwise(old), "contact_id": F.when(hit, F.col("to")).otherwise(F.col("contact_id"))}).drop("to")
    if "n_calls" in out.columns:
        n = moved.where("contact_id is not null").groupBy(F.col("contact_id").alias("id")).agg(F.count_distinct("call_id").alias("_n"))
        out = out.join(n, "id", "left").withColumn("n_calls", F.coalesce("_n", F.lit(0)).cast(contacts.schema["n_calls"].dataType)).drop("_n")
    prints = centroids.join(calls, "call_id").select(F.col("to").alias("contact_id"), F.col("mean").alias("embedding"), F.col("call_id").alias("source_call_id"), F.lit(0.6).alias("quality"))
    if voiceprints is not None:
        kept = voiceprints.join(calls.select(F.col("to").alias("contact_id")).distinct(), "contact_id", "left_anti")
        prints = kept.unionByName(prints, allowMissingColumns=True)
    return {"contacts": out, "segments": moved, "voiceprints": prints}


def seat_for(segments: DataFrame, seats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, seat_id): the nearest seat of the organisation (org_id) that a segment's vector belongs to."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": left["id"][:0], "seat_id": right["seat_id"][:0]})
        right = right.sort_values("seat_id")
        s = np.stack([norm(np.asarray(v, float)) for v in left["embedding"]]) @ np.stack([np.asarray(v, float) for v in right["mean"]]).T
        k = s.argmax(1)
        out = pd.DataFrame({"id": left["id"].to_numpy(), "seat_id": right["seat_id"].to_numpy()[k]})
        return out[s[np.arange(len(k)), k] >= threshold]

    # an organisation's segments are dealt to salts, so that a hot one isn't one task
    salt = F.pmod(F.xxhash64("id"), F.lit(32))
    a = segments.where("embedding is not null").select("id", "org_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), salt.alias("salt"))
    b = seats.select("org_id", "seat_id", "mean").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    return a.groupBy("org_id", "salt").cogroup(b.groupBy("org_id", "salt")).applyInPandas(run, "id long, seat_id long")


def line_counts(calls: DataFrame, contacts: DataFrame) -> DataFrame:
    c = contacts.agg(F.count_if(F.col("kind") == "org").alias("orgs"), F.count_if(F.col("kind") == "seat").alias("seats"))
    return c.join(live(calls).agg(F.count_if(F.col("line_kind") == "shared_line").alias("shared_calls")))


def line_report(contacts: DataFrame, segments: DataFrame, calls: DataFrame, limit: int = 50, newest: int = 12) -> DataFrame:
    """(org, seat, n_calls, recent, unsplit): organisations with seats, each seat's newest calls, calls on none."""
    seats = contacts.where("kind = 'seat'").select(F.col("id").alias("seat_id"), F.col("name").alias("seat"), F.col("parent_id").alias("org_id"))
    orgs = contacts.where("kind = 'org'").select(F.col("id").alias("org_id"), F.col("name").alias("org"))
    mine = segments.where("who = 'other' and contact_id is not null").select("contact_id", "call_id").distinct().join(live(calls).select(F.col("id").alias("call_id"), "call_time"), "call_id")
    n = mine.groupBy("contact_id").agg(F.count("*").alias("n_calls"))
    last = recent(mine, ["contact_id"], [F.col("call_time").desc_nulls_last(), F.desc("call_id")], newest).groupBy("contact_id").agg(F.sort_array(F.collect_list("call_id")).alias("recent"))
    top = orgs.join(seats.select("org_id").distinct(), "org_id", "left_semi").orderBy("org").limit(limit)
    rows = top.join(seats, "org_id").join(n, F.col("seat_id") == n["contact_id"], "left").drop("contact_id").join(last, F.col("seat_id") == last["contact_id"], "left").drop("contact_id")
    rest = n.select(F.col("contact_id").alias("org_id"), F.col("n_calls").alias("unsplit"))
    return rows.join(rest, "org_id", "left").select("org", "seat", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "recent", F.coalesce("unsplit", F.lit(0)).alias("unsplit"))


def merge_back(contacts: DataFrame, rows: dict[str, DataFrame], seats: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Contacts without the given seats (id), and rows that pointed at them pointing at the organisation."""
    m = contacts.join(seats.select("id"), "id", "left_semi").where("parent_id is not null").select(F.col("id").alias("sid"), F.col("parent_id").alias("to"))
    left = contacts.join(m.select(F.col("sid").alias("id")), "id", "left_anti")
    return left, {k: df.join(m, df["contact_id"] == m["sid"], "left").withColumn("contact_id", F.coalesce("to", "contact_id")).select(df.columns) for k, df in rows.items()}
