"""Near-duplicate documents: 64-bit SimHash fingerprints searched through vantage-point trees.

A tree over whole fingerprints can't prune: distances between unrelated ones pile up within a few
bits of 32, so a ball of radius 4 crosses almost every boundary. The forest here bounds the radius
first. The 64 bits are dealt to ``radius + 1`` masks; two fingerprints within the radius agree on at
least one mask, so the tree of that mask, which measures the distance to its vantage points on the
masked bits only, may route by exact distance and still keep the two together. Below, each tree
splits by whole distance to one more vantage point into rings, and a fingerprint near the inner
edge of a ring is also sent to the ring inside, so that pairs that straddle a boundary meet. A
shard is searched by an in-memory tree under the triangle bound. The pairs found are exact: every
link within the radius is seen in some shard; shards return spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.components import with_group
from callweave.llm.common import components, cut, slices, spread

RADIUS = 4
#: Distinct fingerprints that one task of the search is meant to get.
SHARD = 20_000
#: Width of the outer rings in bits, and vantage points of a mask's tree.
RING, LEVELS = 12, 8


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; 0 without a word."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        total += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                fp = np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp)], ["key", "fp"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def masks(radius: int) -> list[int]:
    """radius + 1 disjoint masks over 64 bits, as signed longs."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [int(np.array([sum(1 << b for b in range(lo, hi))], np.uint64).view(np.int64)[0]) for lo, hi in zip(edges, edges[1:], strict=False)]


def vantage_points(n: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(7).integers(-(2**63), 2**63 - 1, n, np.int64)]


def _labels(near: np.ndarray) -> np.ndarray:
    """Component labels under a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        if (new == label).all():
            return label
        label = new


def spanning_links(f: np.ndarray, radius: int = RADIUS, leaf: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (as arrays of positions) that connect exactly what pairs within the radius connect."""
    out = []
    todo = [np.arange(len(f))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        if len(at) <= leaf:
            near = np.bitwise_count(f[at, None] ^ f[None, at]) <= radius
            if near.sum() > len(at):
                label = _labels(near)
                out.append((at, at[label]))
            continue
        for v in at[[0, len(at) // 2, -1]]:
            d = np.bitwise_count(f[at] ^ f[v]).astype(int)
            mid = int(np.median(d))
            # a pair within the radius has both ends in the ball of mid + radius, or both beyond mid
            inside, outside = at[d <= mid + radius], at[d > mid]
            if len(outside) and len(inside) < 0.95 * len(at):
                near = at[d <= radius]
                out.append((near, np.full(len(near), v)))
                todo += [inside, outside]
                break
        else:
            out.append((at, at[_dense(f[at], radius)]))
    return out


def _dense(f: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of points that no vantage point splits, block by block against all."""
    label = np.arange(len(f))
    while True:
        before = label.copy()
        for i in range(0, len(f), 256):
            near = np.bitwise_count(f[i : i + 256, None] ^ f[None, :]) <= radius
            low = np.where(near, label[None, :], len(f)).min(1)
            label = np.minimum(label, np.where(near, low[:, None], len(f)).min(0))
        if (label == before).all():
            return label


def _search(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable")
        f, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        first = np.flatnonzero(np.r_[True, np.diff(pdf["leaf"].to_numpy()) != 0])
        a, b = [], []
        for lo, hi in zip(first, np.r_[first[1:], len(pdf)], strict=True):
            if hi - lo > 1:
                for x, y in spanning_links(f[lo:hi], radius):
                    a.append(rep[lo + x])
                    b.append(rep[lo + y])
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"a": rep[:0], "b": rep[:0]})
        return out[out["a"] != out["b"]]

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between the ``rep`` of distinct (fp, rep) rows within the radius."""
    points = vantage_points(LEVELS + 1)
    trees = []
    for t, mask in enumerate(masks(radius)):
        inner = F.xxhash64(F.lit(t), *[F.bit_count((F.col("fp").bitwiseXOR(F.lit(v))).bitwiseAND(F.lit(mask))) for v in points[:-1]])
        trees.append(F.struct(F.lit(t).alias("tree"), inner.alias("route")))
    d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(points[-1])))
    ring = F.floor(d / RING)
    rings = F.when((d - ring * RING < radius) & (ring > 0), F.array(ring, ring - 1)).otherwise(F.array(ring))
    n = max(1, -(-distinct.count() // shard))
    dealt = (
        distinct.select("fp", "rep", F.explode(F.array(*trees)).alias("t"), d.alias("d"))
        .select("fp", "rep", "t", F.explode(rings).alias("ring"))
        .select("fp", "rep", "t.tree", F.xxhash64("t.route", "ring").alias("leaf"))
        .withColumn("shard", F.pmod("leaf", F.lit(n)))
    )
    return dealt.groupBy("tree", "shard").applyInPandas(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key it reaches.

    A text without a word (null, empty, blank) has fingerprint 0 and is linked like any other.
    Equal fingerprints are one point of the search, so copies cost nothing in it. A row whose key
    is null links others like any row; it isn't the smallest key of a component unless that has only
    such rows, whose component is null. Repeated rows are returned each; other columns are ignored.
    """
    fps = cut(fingerprints(docs, words, seed, key, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("key").alias("smallest")))
    found = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), radius, shard))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "smallest", F.coalesce("component", "fp").alias("group"))
    by_fp = with_group(grouped, ["group"], F.col("fp"), component=F.min("smallest")).select("fp", "component")
    return fps.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component")
