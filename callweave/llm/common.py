"""Helpers shared by the operators: tables, batches of texts, cutting lineage, components."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from callweave.functions.components import components, cut  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in runs of rows of about ``most`` characters, each with its texts as a list."""
    texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, where a small input has fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def merged(symbols: list[int], pairs: dict[int, tuple[int, int]], n: int) -> tuple[list[int], list[int]]:
    """The symbols that survive byte-pair merging of one long sequence, and where each begins.

    ``pairs`` has (rank, symbol) of each pair a * n + b that merges. The lowest rank goes first, the
    leftmost of equals; a heap holds the pairs, so that time grows hardly faster than the length.
    """
    size = len(symbols)
    sym, after, before = list(symbols), list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []
    for i in range(size - 1):
        found = pairs.get(sym[i] * n + sym[i + 1])
        if found:
            heap.append((found[0], i, sym[i] * n + sym[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, pair, into = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= size or sym[i] * n + sym[j] != pair:
            continue
        sym[i], sym[j], after[i] = into, -1, after[j]
        if after[i] < size:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < size:
                key = sym[left] * n + sym[after[left]]
                found = pairs.get(key)
                if found:
                    heapq.heappush(heap, (found[0], left, key, found[1]))
    start = [i for i in range(size) if sym[i] >= 0]
    return [sym[i] for i in start], start
