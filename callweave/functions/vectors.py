"""Vectors as arrays: products and norms in plain columns, and greedy clusterings in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    bound = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))
    # the vector and its length are bound to variables, as each element would take them anew
    return bound(v, lambda w: bound(F.sqrt(dot(w, w)) + 1e-9, lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def sums(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, total, n): element-wise sums of vectors, first within each partition, then across."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def part(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            if len(pdf):
                keys = pdf[by].drop_duplicates()
                code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                m = np.stack([np.asarray(v, float) for v in pdf[vector]])
                total = np.zeros((len(keys), m.shape[1]))
                np.add.at(total, code, m)
                yield keys.assign(total=list(total), n=np.bincount(code))

    schema = f"{kinds}, total array<double>, n long"
    held = rows.where(F.col(vector).isNotNull()).select(*by, doubles(F.col(vector)).alias(vector))
    # a group has a row for each batch that held it; they are added in columns, as a call of Python for each of many small groups takes long
    found = held.mapInPandas(part, schema).groupBy(*by).agg(F.collect_list("total").alias("_t"), F.sum("n").alias("n"))
    every = F.aggregate(F.slice("_t", F.lit(2), F.size("_t")), F.get("_t", F.lit(0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return found.select(*by, every.alias("total"), "n")


def means(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, mean, n): unit-length mean of the vectors of each group."""
    return sums(rows, by, vector).select(*by, unit(F.transform("total", lambda x: x / F.col("n"))).alias("mean"), "n")


def norm(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-9)


def first_fit(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster of each vector: the first whose running mean is near enough, else a new one."""
    return _greedy(vectors, threshold, lambda s: np.flatnonzero(s >= threshold)[:1])


def best_fit(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster of each vector: the nearest if it is near enough, else a new one."""
    return _greedy(vectors, threshold, lambda s: [int(s.argmax())] if s.max() >= threshold else [])


def _greedy(vectors, threshold, choose) -> list[int]:
    centres, sizes, out = np.zeros((0, vectors.shape[1] if len(vectors) else 0)), [], []
    for v in vectors:
        found = choose(centres @ v) if len(sizes) else []
        if len(found):
            k = int(found[0])
            centres[k] = norm(centres[k] * sizes[k] + v)
            sizes[k] += 1
        else:
            k = len(sizes)
            centres = np.vstack([centres, v])
            sizes.append(1)
        out.append(k)
    return out


def average_linkage(vectors: np.ndarray, k: int = 2) -> list[int]:
    """Labels by first appearance of k clusters of average linkage on cosine distance.

    Fewer than three vectors are one speaker, as are two clusters whose centres are closer than 0.8.
    Merges are found by chains of nearest neighbours: two clusters that are each other's nearest will
    be merged in any case, so a chain that ends in such a pair merges it, in all in quadratic time. The
    n - k lowest merges are those of always merging the nearest pair.
    """
    n = len(vectors)
    if n < 3:
        return [0] * n
    x = np.stack([norm(v) for v in vectors])
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, live, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(live.argmax()))
        while True:
            row = d[chain[-1]]
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                break
            chain.append(j)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((d[a, b], a, b))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        merged[[a, b]] = np.inf
        d[a], d[:, a], d[b], d[:, b] = merged, merged, np.inf, np.inf
        size[a] += size[b]
        live[b] = False
    label = list(range(n))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        i, j = root(a), root(b)
        label[max(i, j)] = min(i, j)
    own = [root(i) for i in range(n)]
    groups = list(dict.fromkeys(own))
    if len(groups) == 2:
        a, b = (norm(x[np.array(own) == g].mean(0)) for g in groups)
        if float(a @ b) > 0.8:
            return [0] * n
    return [groups.index(g) for g in own]
