"""Greedy clustering by priority in parallel rounds: one answer, whatever the partitions are.

The plain loop takes the vectors of a group in order: one that is near an earlier leader follows,
one that isn't leads from then on. In rounds: the first rows of each group that are still open are
settled among themselves, and all other open rows near one of the leaders found are closed. A row is
open as long as no earlier leader is near, so the leaders are the loop's. What a task gets is bounded:
BLOCK rows to settle, or PIECE rows of a group against the leaders of one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.components import SALTS, cut, with_group
from callweave.functions.vectors import sums, unit

#: Rows of a group that are settled in one task a round, and rows of a group that a task compares.
BLOCK, PIECE = 4096, 50_000


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def sortable(number: Column) -> Column:
    """A whole number as text of 16 hex digits that sorts as the number does."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, salt: Column) -> DataFrame:
    """The first n rows of each group in an order: first of each salt of a group, then of those."""
    of = lambda df, keys: df.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_no") <= n).drop("_no")
    return of(of(rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))), [*by, "_salt"]).drop("_salt"), by)


def settle(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows lead, in order: those that no earlier leader is near."""
    n = len(vectors)
    lead, shut = np.zeros(n, bool), np.zeros(n, bool)
    step = max(1, (1 << 22) // max(1, n))
    for start in range(0, n, step):
        near = vectors[start : start + step] @ vectors.T >= threshold
        for i in range(len(near)):
            if not shut[start + i]:
                lead[start + i] = True
                shut |= near[i]
    return lead


def pieces(rows: DataFrame, others: DataFrame, by: list[str], key: str, piece: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _piece: a group's rows are dealt to pieces of about so many, its others go to each."""
    size = F.ceil(F.count("*") / F.lit(piece)).cast("int")
    dealt = with_group(rows, by, F.col(key), _n=size).withColumn("_piece", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).drop("_n")
    every = others.join(rows.groupBy(*by).agg(size.alias("_n")), by).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return dealt, every


def leaders(rows: DataFrame, threshold: float, group: str, order: str, vector: str = "v", block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(group, order, vector) of the leaders of each group.

    Vectors are of unit length; groups and orders aren't null, and an order is distinct in its group.
    """
    kinds = f"{group} {rows.schema[group].dataType.simpleString()}, {order} {rows.schema[order].dataType.simpleString()}, {vector} array<double>"
    names = [group, order, vector]

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[settle(stacked(pdf[vector]), threshold)][names]

    def still(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[names]
        lead = stacked(right[vector])
        near = np.concatenate([(stacked(left[vector].iloc[i : i + 2048]) @ lead.T >= threshold).any(1) for i in range(0, len(left), 2048)])
        return left[~near][names]

    found = None
    left = cut(rows.select(*names))
    while not left.isEmpty():
        top = cut(first_rows(left, [group], [F.col(order)], block, F.col(order)))
        new = cut(top.groupBy(group).applyInPandas(head, kinds))
        found = new if found is None else found.unionByName(new)
        # of groups that had more rows than were settled, what comes after those
        last = cut(top.groupBy(group).agg(F.max(order).alias("_last"), F.count("*").alias("_n")).where(F.col("_n") == block).drop("_n"))
        if last.isEmpty():
            break
        rest = left.join(last, group).where(F.col(order) > F.col("_last")).select(*names)
        a, b = pieces(rest, new, [group], order, piece)
        left = cut(a.groupBy(group, "_piece").cogroup(b.groupBy(group, "_piece")).applyInPandas(still, kinds))
    return rows.sparkSession.createDataFrame([], kinds) if found is None else found


def followed(rows: DataFrame, lead: DataFrame, threshold: float, group: str, order: str, vector: str = "v", best: bool = True, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(group, order, leader, sim) of every row: the nearest leader that isn't later; with ``best`` off the first that is near.

    A group's leaders come in blocks of about so many, so that a task holds a piece of rows and a block.
    """
    kind = rows.schema[order].dataType.simpleString()
    schema = f"{group} {rows.schema[group].dataType.simpleString()}, {order} {kind}, leader {kind}, sim double"

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({group: left[group][:0], order: left[order][:0], "leader": left[order][:0], "sim": pd.Series([], dtype=float)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values(order)
        m, at, out = stacked(right[vector]), right[order].to_numpy(), [none]
        for i in range(0, len(left), 2048):
            part = left.iloc[i : i + 2048]
            own = part[order].to_numpy()
            code = np.unique(np.concatenate([own, at]), return_inverse=True)[1]
            own_no, at_no = code[: len(own), None], code[None, len(own) :]
            s = stacked(part[vector]) @ m.T
            s = np.where(own_no == at_no, 1.0, np.where((at_no < own_no) & (s >= threshold), s, -np.inf))
            k = s.argmax(1) if best else (s > -np.inf).argmax(1)
            sim = s[np.arange(len(k)), k]
            out.append(pd.DataFrame({group: part[group].to_numpy(), order: own, "leader": at[k], "sim": sim})[sim > -np.inf])
        return pd.concat(out)

    n = lead.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    a = rows.select(group, order, vector).join(n, group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    b = lead.join(n, group).withColumn("_block", F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int")).drop("_blocks")
    a, b = pieces(a, b, [group, "_block"], order, piece)
    every = a.groupBy(group, "_block", "_piece").cogroup(b.groupBy(group, "_block", "_piece")).applyInPandas(meet, schema)
    by = F.struct((-F.col("sim")).alias("s"), "leader") if best else F.col("leader")
    return every.groupBy(group, order).agg(F.min_by(F.struct("leader", "sim"), by).alias("_p")).select(group, order, "_p.*")


def joined_up(clusters: DataFrame, threshold: float, group: str, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(group, first, to) of clusters (group, first, size, total) whose means come to be near.

    Largest first (of equals the smaller first), a cluster that is near a leading one joins the
    nearest such; means are taken anew, until nothing joins. ``first`` is text and names a cluster,
    ``total`` is the sum of its vectors.
    """
    now = cut(clusters.select(group, "first", F.col("size").cast("long").alias("size"), "total"))
    moved = now.select(group, "first", F.col("first").alias("to"))
    while True:
        ranked = now.select(group, F.concat(sortable(-F.col("size")), "first").alias("_order"), unit(F.col("total")).alias("v"))
        step = followed(ranked, leaders(ranked, threshold, group, "_order", "v", block, piece), threshold, group, "_order", "v", True, block, piece)
        # 16 digits of the size come before the name
        name = lambda c: F.substr(F.col(c), F.lit(17))
        step = cut(step.where("leader <> _order").select(group, name("_order").alias("first"), name("leader").alias("_to")))
        if step.isEmpty():
            return moved
        now = now.join(step, [group, "first"], "left").withColumn("first", F.coalesce("_to", "first")).drop("_to")
        total = sums(now, [group, "first"], "total").select(group, "first", "total")
        now = cut(now.groupBy(group, "first").agg(F.sum("size").alias("size")).join(total, [group, "first"]))
        moved = cut(moved.join(step.withColumnRenamed("first", "to"), [group, "to"], "left").select(group, "first", F.coalesce("_to", "to").alias("to")))
