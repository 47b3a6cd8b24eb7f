"""Exact search among vectors on the sphere: pivot cells, with bounds by the angle's triangle inequality.

A bounded number of the targets are pivots. A target is in the cell of its nearest pivot and in a ring
of its angle to it. No target of a ring is nearer to a query than the difference of its angles allows,
nor nearer than the plane between the cell's pivot and the query's own; the larger of both bounds says
which rings a query has to meet at all. Rings of many targets come in blocks and queries in pieces, so
that no task holds more than a block and a piece, however many vectors are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.components import cut
from callweave.functions.leaders import pieces, stacked

#: Pivots at most (they go to every task), radians of a ring, targets of a block, queries of a piece.
PIVOTS, RING, BLOCK, PIECE = 1024, 0.1, 4096, 50_000
#: What rounding may add to an angle.
SLACK = 1e-6


@dataclass
class Cells:
    """pivots; the plane distances between them; and of each ring its cell, least and greatest angle, and blocks."""

    pivots: np.ndarray
    apart: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def least(self, v: np.ndarray) -> np.ndarray:
        """A lower bound of the angle of each vector to what is in each ring."""
        s = v @ self.pivots.T
        angle = np.arccos(np.clip(s, -1, 1))
        own = s.argmax(1)
        plane = np.arcsin(np.clip((s[np.arange(len(v)), own][:, None] - s) / self.apart[own], 0, 1))
        a = angle[:, self.cell]
        return np.maximum(np.maximum(np.maximum(a - self.high, self.low - a), plane[:, self.cell]), 0) - SLACK


def cells_of(targets: DataFrame, key: str, vector: str, pivots: int = PIVOTS, ring: float = RING, block: int = BLOCK) -> tuple[Cells, DataFrame] | None:
    """The cells, and (key, vector, _ring, _block) of each target; None without targets. Vectors are of unit length."""
    n = targets.count()
    if n == 0:
        return None
    chosen = targets.orderBy(F.xxhash64(key), key).limit(min(pivots, max(1, int(n**0.5)))).select(vector).collect()
    p = np.unique(np.array([r[0] for r in chosen], float), axis=0)
    kind = targets.schema[key].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            if len(pdf):
                s = stacked(pdf[vector]) @ p.T
                own = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(own)), own], -1, 1))
                yield pd.DataFrame({key: pdf[key], vector: pdf[vector], "_cell": own, "_ring": (angle / ring).astype(int), "_angle": angle})

    placed = cut(targets.select(key, vector).mapInPandas(place, f"{key} {kind}, {vector} array<double>, _cell int, _ring int, _angle double"))
    held = placed.groupBy("_cell", "_ring").agg(F.min("_angle"), F.max("_angle"), F.ceil(F.count("*") / F.lit(block)).cast("int")).orderBy("_cell", "_ring").collect()
    cols = [np.array(c) for c in zip(*held, strict=True)]
    square = np.clip(2 - 2 * p @ p.T, 1e-12, None)
    found = Cells(p, np.sqrt(square), *cols)
    no = {(r[0], r[1]): (i, r[4]) for i, r in enumerate(held)}
    table = placed.sparkSession.createDataFrame([(a, b, i, n) for (a, b), (i, n) in no.items()], "_cell int, _ring int, _no int, _n int")
    dealt = placed.join(F.broadcast(table), ["_cell", "_ring"])  # at most PIVOTS cells of pi / ring rings
    return found, dealt.select(key, vector, F.col("_no").alias("_ring"), F.pmod(F.xxhash64(key), F.col("_n")).cast("int").alias("_block"))


def _to_meet(rows: DataFrame, key: str, vector: str, found: Cells, least: float, best: str | None = None, first: bool = False, own: str | None = None) -> DataFrame:
    """(key, vector, _ring, _block) for each ring that a query has to meet.

    With a column ``best``, of the cosine that it has found so far: the likeliest ring, or all others
    that may hold one as large. With a column ``own``, of its own ring: that one and later ones.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                bound = found.least(stacked(part[vector]))
                limit = np.full(len(part), least) if best is None else np.fmax(part[best].to_numpy(float), least)
                want = np.cos(np.maximum(bound, 0)) >= limit[:, None] - SLACK
                if best is not None:
                    # of equal bounds, the ring whose middle is nearest
                    s = stacked(part[vector]) @ found.pivots.T
                    off = np.abs(np.arccos(np.clip(s, -1, 1))[:, found.cell] - (found.low + found.high) / 2)
                    top = np.lexsort((off, bound), axis=1)[:, 0]
                    likeliest = np.zeros(want.shape, bool)
                    likeliest[np.arange(len(part)), top] = True
                    want &= likeliest if first else ~likeliest
                if own is not None:
                    want &= np.arange(len(found.cell))[None] >= part[own].to_numpy()[:, None]
                at, ring = np.nonzero(want)
                n = found.blocks[ring]
                at, ring = np.repeat(at, n), np.repeat(ring, n)
                yield pd.DataFrame({key: part[key].to_numpy()[at], vector: part[vector].to_numpy()[at], "_ring": ring, "_block": np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)})

    return rows.mapInPandas(run, f"{key} {kind}, {vector} array<double>, _ring int, _block int")


def nearest(rows: DataFrame, targets: DataFrame, threshold: float, key: str, target: str, vector: str = "v", mean: str = "mean", pivots: int = PIVOTS, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(key, target, sim, looked): the nearest target of each row, if its cosine is the threshold or more.

    Of equally near targets the smallest. ``looked`` counts the targets that the row was compared with.
    A row meets its likeliest ring first, then only those rings that could still hold something nearer.
    """
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {target} {targets.schema[target].dataType.simpleString()}, sim double, looked long"
    made = cells_of(targets.select(target, mean), target, mean, pivots, block=block)
    if made is None:
        return rows.sparkSession.createDataFrame([], kinds)
    found, dealt = made
    dealt = cut(dealt)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({key: left[key][:0], target: right[target][:0], "sim": pd.Series([], dtype=float), "looked": pd.Series([], dtype=int)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values(target)
        m, ids, out = stacked(right[mean]), right[target].to_numpy(), [none]
        for i in range(0, len(left), 2048):
            part = left.iloc[i : i + 2048]
            s = stacked(part[vector]) @ m.T
            k = s.argmax(1)
            out.append(pd.DataFrame({key: part[key].to_numpy(), target: ids[k], "sim": s[np.arange(len(k)), k], "looked": len(ids)}))
        return pd.concat(out)

    def round_of(df: DataFrame, first: bool) -> DataFrame:
        a, b = pieces(_to_meet(df, key, vector, found, threshold, "best", first), dealt, ["_ring", "_block"], key, piece)
        keys = ["_ring", "_block", "_piece"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(meet, kinds)

    top = lambda df: df.groupBy(key).agg(F.min_by(F.struct(target, "sim"), F.struct((-F.col("sim")).alias("s"), target)).alias("_p"), F.sum("looked").alias("looked")).select(key, f"_p.{target}", "_p.sim", "looked")
    start = cut(rows.select(key, vector))
    one = cut(top(round_of(start.withColumn("best", F.lit(None).cast("double")), True)))
    # a tie may be in another ring: its bound is at most the best so far, so it is met as well
    two = round_of(start.join(one.select(key, F.col("sim").alias("best")), key, "left"), False)
    return top(one.unionByName(two)).where(F.col("sim") >= threshold)


def near_links(rows: DataFrame, threshold: float, key: str, vector: str = "mean", pivots: int = PIVOTS, block: int = 2048, piece: int = 2048) -> DataFrame:
    """(a, b, looked): links that connect whatever has a cosine of the threshold or more, a < b.

    A task returns a forest over the near pairs of its piece and block, not all of those pairs: the
    connected components of the links are those of all near pairs. ``looked`` is how many pairs a
    task compared, on the first of its rows; a task without links gives a row of nulls with it.
    """
    kind = rows.schema[key].dataType.simpleString()
    kinds = f"a {kind}, b {kind}, looked long"
    made = cells_of(rows.select(key, vector), key, vector, pivots, block=block)
    if made is None:
        return rows.sparkSession.createDataFrame([], kinds)
    found, dealt = made
    dealt = cut(dealt)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left[key][:0], "b": left[key][:0], "looked": pd.Series([], dtype=int)})
        ids, code = np.unique(np.concatenate([left[key].to_numpy(), right[key].to_numpy()]), return_inverse=True)
        x, y = code[: len(left)], code[len(left) :]
        near = stacked(left[vector]) @ stacked(right[vector]).T >= threshold
        i, j = np.nonzero(near)
        low = np.arange(len(ids))
        while True:  # the smallest number that each reaches
            before = low.copy()
            np.minimum.at(low, x[i], low[y[j]])
            np.minimum.at(low, y[j], low[x[i]])
            low = low[low]
            if (low == before).all():
                break
        b = np.flatnonzero(low < np.arange(len(ids)))
        out = pd.DataFrame({"a": ids[low[b]], "b": ids[b], "looked": 0}) if len(b) else pd.DataFrame({"a": [None], "b": [None], "looked": [0]})
        out.loc[out.index[0], "looked"] = near.size
        return out

    own = dealt.select(key, vector, F.col("_ring").alias("own"))
    a, b = pieces(_to_meet(own, key, vector, found, threshold, own="own"), dealt, ["_ring", "_block"], key, piece)
    keys = ["_ring", "_block", "_piece"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(meet, kinds)
