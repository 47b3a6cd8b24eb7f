"""The graph of relations: people, events and topics of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import ANALYSIS
from callweave.operators.stats import done, label, live

# Words of courier and taxi calls.
SERVICE_WORDS = [
    "快递", "包裹", "取件", "驿站", "派件", "签收", "放门口", "前台", "到付", "外卖", "骑手", "闪送", "餐品", "送达", "下单", "打车", "网约车", "出租车",
    "师傅", "车牌", "尾号", "上车", "接单",
]
MOST = 6
ME = "我"


def service_calls(calls: DataFrame, segments: DataFrame, keywords: list[str] | None = None, max_sec: float = 180) -> DataFrame:
    """(id) of done calls about deliveries and rides: two keywords, or one in a short call.

    Each segment gives the keywords it holds, so that no call's text is joined up; a word that
    spans two segments isn't one.
    """
    words = F.array(*map(F.lit, keywords or SERVICE_WORDS))
    held = segments.where("text_zh is not null").select("call_id", F.filter(words, lambda k: F.contains(F.col("text_zh"), k)).alias("k")).where(F.size("k") > 0)
    hits = held.select("call_id", F.explode("k").alias("k")).groupBy("call_id").agg(F.count_distinct("k").alias("hits"))
    rows = live(calls).where(done()).join(hits, calls["id"] == hits["call_id"])
    return rows.where((F.col("hits") >= 2) | (F.coalesce("duration_sec", F.lit(0.0)) <= max_sec)).select("id")


def talked_edges(segments: DataFrame, calls: DataFrame, service: DataFrame) -> DataFrame:
    """(contact_id, weight, edge_time): segments of the other side and the newest call."""
    c = live(calls).join(service, "id", "left_anti").select(F.col("id").alias("call_id"), "call_time")
    rows = segments.where("who = 'other' and contact_id is not null").select("contact_id", "call_id").join(c, "call_id")
    return rows.groupBy("contact_id").agg(F.count("*").alias("weight"), F.max("call_time").alias("edge_time"))


def _analysed(calls: DataFrame, service: DataFrame) -> DataFrame:
    rows = live(calls).where("analysis is not null").join(service, "id", "left_anti")
    return rows.withColumn("a", F.from_json("analysis", ANALYSIS)).where("a is not null")


def extract_events(calls: DataFrame, service: DataFrame) -> DataFrame:
    """(call_id, no, title, description, event_time, participants, contact_hint): the first six events, blanks dropped."""
    rows = _analysed(calls, service).select("id", "call_time", "contact_hint", F.coalesce(label(), F.lit("对方")).alias("other"), F.col("a.summary").alias("description"), F.posexplode(F.slice("a.events", 1, MOST)).alias("no", "raw"))
    title = F.trim("raw")
    return rows.where(title != "").select(F.col("id").alias("call_id"), "no", title.alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.col("call_time").alias("event_time"), F.array("other").alias("participants"), "contact_hint")


def involves_edges(events: DataFrame, contacts: DataFrame) -> DataFrame:
    """(src, call_id, no, edge_time): me and, where the hint is a contact's name, that contact to each event."""
    mine = events.select(F.lit("me").alias("src"), "call_id", "no", F.col("event_time").alias("edge_time"))
    named = contacts.groupBy("name").agg(F.min("id").alias("cid"))
    theirs = events.join(named, events["contact_hint"] == named["name"]).select(F.concat(F.lit("contact:"), F.col("cid").cast("string")).alias("src"), "call_id", "no", F.col("event_time").alias("edge_time"))
    return mine.unionByName(theirs)


def topic_edges(calls: DataFrame, service: DataFrame) -> DataFrame:
    """(topic, call_id, weight, edge_time): the first six topics of a call, each once."""
    rows = _analysed(calls, service).select(F.col("id").alias("call_id"), F.col("call_time").alias("edge_time"), F.explode(F.slice("a.topics", 1, MOST)).alias("topic"))
    return rows.dropDuplicates(["topic", "call_id"]).select("topic", "call_id", F.lit(1).alias("weight"), "edge_time")


def graph_nodes(contacts: DataFrame, events: DataFrame, topics: DataFrame) -> DataFrame:
    """(node, type, label); nodes are named by type and key."""
    spark = contacts.sparkSession
    me = spark.range(1).select(F.lit("me").alias("node"), F.lit("me").alias("type"), F.lit(ME).alias("label"))
    c = contacts.select(F.concat(F.lit("contact:"), F.col("id").cast("string")).alias("node"), F.lit("contact").alias("type"), F.col("name").alias("label"))
    e = events.select(event_node().alias("node"), F.lit("event").alias("type"), F.col("title").alias("label"))
    t = topics.select(F.concat(F.lit("topic:"), "topic").alias("node"), F.lit("topic").alias("type"), F.col("topic").alias("label")).distinct()
    return me.unionByName(c).unionByName(e).unionByName(t)


def event_node():
    return F.concat(F.lit("event:"), F.col("call_id").cast("string"), F.lit(":"), F.col("no").cast("string"))


def graph_edges(talked: DataFrame, involves: DataFrame, topics: DataFrame, contacts: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, call_id, edge_time)."""
    no_call = F.lit(None).cast("long").alias("call_id")
    known = talked.join(contacts.select(F.col("id").alias("contact_id")), "contact_id", "left_semi")
    a = known.select(F.lit("me").alias("src"), F.concat(F.lit("contact:"), F.col("contact_id").cast("string")).alias("dst"), F.lit("talked").alias("kind"), F.col("weight").cast("long").alias("weight"), no_call, "edge_time")
    b = involves.select("src", event_node().alias("dst"), F.lit("involves").alias("kind"), F.lit(1).cast("long").alias("weight"), "call_id", "edge_time")
    c = topics.select(F.lit("me").alias("src"), F.concat(F.lit("topic:"), "topic").alias("dst"), F.lit("topic").alias("kind"), F.col("weight").cast("long").alias("weight"), "call_id", "edge_time")
    return a.unionByName(b).unionByName(c)


def graph_slice(nodes: DataFrame, edges: DataFrame, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree (twice the incident edges) and edges in a range of time or without one."""
    t = F.col("edge_time")
    rows = edges
    if since:
        rows = rows.where(t.isNull() | (t >= F.lit(since).cast("timestamp")))
    if until:
        rows = rows.where(t.isNull() | (t < F.lit(until).cast("timestamp")))
    ends = rows.select(F.explode(F.array("src", "dst")).alias("node"))
    deg = ends.groupBy("node").agg((2 * F.count("*")).alias("deg"))
    kept = nodes.join(deg, "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0))).where("deg > 0 or type = 'me'")
    names = kept.select("node")
    out = rows.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, out.select("src", "dst", "kind", "weight", "call_id", "edge_time")


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element): each node and edge as a JSON text."""
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("node").alias("id"), "label", "type", "deg").alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight", F.col("edge_time").cast("string").alias("time"), "call_id").alias("data"))).alias("element"))
    return n.unionByName(e)


def event_timeline(events: DataFrame, calls: DataFrame, limit: int = 200) -> DataFrame:
    rows = events.join(calls.select(F.col("id").alias("cid"), "filename"), events["call_id"] == F.col("cid"), "left")
    return rows.select("call_id", "no", "title", "event_time", "filename").orderBy(F.col("event_time").desc_nulls_last(), F.desc("call_id"), "no").limit(limit)
