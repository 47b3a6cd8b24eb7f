"""Ranked lexical search: range maxima over posting lists bound intervals of documents, best first.

The queries come in blocks of a bounded number of terms. For a block, one pass over the texts keeps
of each document its length and the counts of the block's terms, as a table; counts over that table
give the weights. Then every batch of documents becomes a shard: posting lists with their impacts and
one sparse table of range maxima over all of them. For each query, intervals of the shard's documents
wait in a heap under the sum of their lists' maxima. The best one is split at the document of its
greatest impact, which is scored; an interval with few postings is scored whole; one that can't reach
the last of the ranks found so far (in any shard of the task) is left. Each task returns its ranks of
each query, so what is shuffled grows with the tasks, not with the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callweave.llm.common import cut, slices, spread

#: Terms of queries in a block, about.
BLOCK = 200_000
#: Postings of a shard at most (more only for a single document of more terms).
SHARD = 1 << 19
#: Postings of an interval that is scored whole.
LEAF = 2048
#: Parts that the ranks of one query are first reduced in.
SALTS = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """ASCII letters (A-Z as a-z), digits and whatever isn't ASCII, in maximal runs, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Ranks:
    """The best rows of one query so far: by score, then by key, null keys last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def open(self, score: int, first: tuple) -> bool:
        """Whether a row of that score, with the key ``first`` or a later one, could come in."""
        return score > 0 and (len(self.rows) < self.top or (-score, first) < self.rows[-1])

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted([*self.rows, *rows])[: self.top]

    @property
    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.top else 1


class Shard:
    """Posting lists of some documents, their impacts, and a sparse table of range maxima."""

    def __init__(self, keys: list, lengths: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """at, term, tf: the row, term and count of each posting. n_docs, n_terms: of the corpus."""
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
        self.keys = [(keys[i] is None, keys[i]) for i in order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        m = 10 + (90 * lengths * n_docs) // n_terms
        self.place_of = term.astype(np.int64) * len(keys) + place[at]
        by = np.argsort(self.place_of, kind="stable")
        self.place_of, term, tf, at = self.place_of[by], term[by], tf[by].astype(np.int64), at[by]
        self.doc = place[at]
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        self.begin = np.searchsorted(term, np.arange(len(weights) + 1))
        longest = int(np.diff(self.begin).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(1, longest.bit_length()):
            self.log[1 << k :] = k
        self.table = np.tile(np.arange(len(term), dtype=np.int32), (int(self.log[-1]) + 1, 1))
        for k in range(1, len(self.table)):
            half, n = 1 << (k - 1), len(term) - (1 << k) + 1
            a, b = self.table[k - 1, :n], self.table[k - 1, half : half + n]
            self.table[k, :n] = np.where(self.impact[b] > self.impact[a], b, a)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of greatest impact in each [a, b), none of them empty; the first of equals."""
        k = self.log[b - a]
        x, y = self.table[k, a], self.table[k, b - (1 << k)]
        return np.where(self.impact[y] > self.impact[x], y, x)

    def search(self, wanted: np.ndarray, ranks: Ranks, leaf: int = LEAF) -> int:
        """Puts the shard's best documents for the terms ``wanted`` into ranks; the postings scored."""
        heap: list[tuple] = []
        seen = 0

        def push(term: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            some = a < b
            term, a, b = term[some], a[some], b[some]
            if len(term):
                top = self.maxima(a, b)
                impact = self.impact[top]
                bound, first = int(impact.sum()), int(self.doc[a].min())
                if ranks.open(bound, self.keys[first]):
                    heapq.heappush(heap, (-bound, first, len(heap), term, a, b, int(self.doc[top[impact.argmax()]])))

        push(wanted, self.begin[wanted], self.begin[wanted + 1])
        # each split may cut off one document only; beyond so many, what is left is scored whole
        splits = 8 + 4 * int((self.begin[wanted + 1] - self.begin[wanted]).sum()) // leaf
        while heap:
            bound, first, _, term, a, b, d = heapq.heappop(heap)
            if not ranks.open(-bound, self.keys[first]):
                continue
            n = b - a
            size = int(n.sum())
            if size <= leaf or splits == 0:
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(size)
                score = np.zeros(int(self.doc[b - 1].max()) + 1 - first, np.int64)
                np.add.at(score, self.doc[at] - first, self.impact[at])
                good = np.flatnonzero(score >= ranks.least)
                good = good[np.argsort(-score[good], kind="stable")[: ranks.top]]
                ranks.add([(-int(score[i]), self.keys[first + i]) for i in good])
                seen += size
                continue
            splits -= 1
            mid = np.searchsorted(self.place_of, term * len(self.keys) + d)
            here = (mid < b) & (self.doc[np.minimum(mid, len(self.doc) - 1)] == d)
            score = int(self.impact[mid[here]].sum())
            seen += int(here.sum())
            if score:
                ranks.add([(-score, self.keys[d])])
            push(term, a, mid)
            push(term, mid + here, b)
        return seen


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, term, tf) of each row with a term: terms in all, and which of the vocabulary how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                n, term, tf, size = [], [], [], [0]
                for t in texts:
                    words = terms(t)
                    n.append(len(words))
                    found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    term += [x for x, _ in found]
                    tf += [c for _, c in found]
                    size.append(len(term))
                lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), *lists], ["key", "n", "term", "tf"])
                yield out.filter(pa.array([x > 0 for x in n]))

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, term array<int>, tf array<int>")


def shards(batch: pa.RecordBatch, most: int = SHARD) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of the batch's rows with at most so many postings: keys, lengths, and row, term, count of each posting."""
    offset = batch.column(2).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offset, offset[start] + most, "right")) - 1)
        part = batch.slice(start, end - start)
        size = np.diff(offset[start : end + 1])
        yield part.column(0).to_pylist(), part.column(1).to_numpy(), np.repeat(np.arange(end - start), size), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
        start = end


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): each term of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                each = [sorted(set(terms(t))) for t in texts]
                at = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), pa.array([w for x in each for w in x], pa.binary())], ["item", "term"])

    rows = items.select(items[item].alias("item"), items[text].alias("text"))
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


def _ranks_of_block(docs: DataFrame, wanted: DataFrame, top: int, key: str, text: str) -> DataFrame:
    """(item, key, score): the ranks that each task finds for the items of one block."""
    schema = f"item {wanted.schema['item'].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, score long"
    queries = [(r.item, [bytes(t) for t in r.terms]) for r in wanted.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, x in queries for w in x}))}
    index = cut(counted(docs, vocabulary, key, text))
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    df = dict(index.select(F.explode("term").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    queries = [(x, np.array(sorted(vocabulary[w] for w in t), np.int64)) for x, t in queries]
    kinds = [to_arrow_type(wanted.schema["item"].dataType), to_arrow_type(docs.schema[key].dataType), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Ranks(top) for _ in queries]
        for batch in batches:
            for part in shards(batch):
                if len(part[2]):
                    shard = Shard(*part, weights, n_docs, n_terms)
                    for (_, t), ranks in zip(queries, found, strict=True):
                        shard.search(t, ranks)
        rows = [(x, k, -s) for (x, _), ranks in zip(queries, found, strict=True) for s, (_, k) in ranks.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["item", "key", "score"])

    return index.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): for each item the ``top`` best rows of docs with a score above 0.

    Scores are exact; equal ones go by ascending key, null keys last. Rows that repeat a key are
    documents of their own. Rows of items with one item id are one query with the terms of all; a
    null id is an id; items without a term, and null and empty texts, give no rows. Other columns
    are ignored, whatever their names.
    """
    wanted = cut(item_terms(items, item, item_text))
    n_blocks = max(1, -(-wanted.count() // block))
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    found = reduce(DataFrame.union, [_ranks_of_block(docs, numbered.where(F.col("block") == i).drop("block"), top, key, text) for i in range(n_blocks)])
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    parts = Window.partitionBy("item", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT doc_id, n, unnest(w) AS term FROM c),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT doc_id, p.term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))) AS impact FROM p JOIN f USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 10
"""
