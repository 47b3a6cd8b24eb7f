"""Quality scores by a generalised additive model with pairwise interactions.

A text is a few shares and sizes. The model is a lookup table over the bins of each feature and of a
few pairs of features; a score is the sigmoid of the sum of a text's bins. Tables are learned by
cyclic boosting: in turn, each feature gets a shallow tree over its own bins (three leaves, a small
step), until rows set aside don't gain any more; then the pairs whose best cut into four leaves the
most gain in what is left are boosted in turn likewise. It is fitted in one task, on the features of
a documented, bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
import pickle
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices, spread

#: Labelled rows that the model is fitted on at most (those with the smallest hashes of their keys).
SAMPLE = 20_000
#: Bins of a feature, bins of a feature within a pair, and pairs.
BINS, PAIR_BINS, PAIRS = 64, 16, 10
FEATURES = [
    "words", "word_length", "distinct_words", "top_word", "repeated_lines", "words_a_line", "capitals", "capital_words", "digits",
    "marks", "bars", "hashes", "shouts", "other_symbols", "not_ascii", "odd_ends", "inner_change", "bits_a_char",
]
_BLANK, _LOWER, _UPPER, _DIGIT, _MARK, _OTHER = range(6)


def _kind(i: int) -> int:
    c = chr(i)
    if c in " \t\n\x0b\x0c\r":
        return _BLANK
    general = unicodedata.category(c)
    if general[0] == "L":
        return _UPPER if general in ("Lu", "Lt") else _LOWER
    return _DIGIT if general[0] == "N" else _MARK if c in ".,;:!?'\"()-" else _OTHER


#: Kind of each character; those beyond the table count as letters.
_KINDS = np.array([_kind(i) for i in range(0x3000)] + [_LOWER], np.uint8)


def measure(text: str | None) -> list[float]:
    """The features of a whole text, all finite."""
    text = text or ""
    chars = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(_KINDS) - 1)
    kind = _KINDS[chars]
    n = np.bincount(kind, minlength=6)
    full = int(len(chars) - n[_BLANK])
    inside = np.concatenate([[False], kind != _BLANK, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = kind[edge[::2]], kind[edge[1::2] - 1]
    words = text.encode().split()
    count = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ascii_chars = np.bincount(chars[chars < 128], minlength=128)
    share = ascii_chars / max(1, full)
    odds = ascii_chars[ascii_chars > 0] / max(1, len(chars))
    change = np.count_nonzero((kind[1:] != kind[:-1]) & (kind[1:] != _BLANK) & (kind[:-1] != _BLANK)) if len(kind) else 0
    at = lambda s: float(sum(share[ord(c)] for c in s))
    return [
        np.log1p(len(words)),
        full / max(1, len(words)),
        len(count) / max(1, len(words)) ** 0.75,
        max(count.values(), default=0) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        n[_UPPER] / max(1, n[_UPPER] + n[_LOWER]),
        np.count_nonzero(first == _UPPER) / max(1, len(first)),
        n[_DIGIT] / max(1, full),
        n[_MARK] / max(1, full),
        at("|"),
        at("#*$%&"),
        at("!"),
        n[_OTHER] / max(1, full) - at("|#*$%&"),
        1 - float(share.sum()) + at(" \t\n\x0b\x0c\r") if full else 0.0,
        np.count_nonzero((last == _OTHER) | (last == _DIGIT)) / max(1, len(last)),
        change / max(1, full),
        float(-(odds * np.log2(odds)).sum()),
    ]


@dataclass
class Gam:
    """edges: what separates the bins of each feature. tables: of features; pair_tables: of pairs."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of the rows of x, a row of bins for each feature."""
        return np.array([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], np.int64).reshape(len(self.edges), len(x))

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.bias)
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        coarse = bins * PAIR_BINS // BINS
        for t, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            out += t[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(self.bins(x))) if self.edges else np.full(len(x), float(sigmoid(self.bias)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, weight: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Values over ordered bins with gradients g and curvatures h: a tree of a few leaves, grown by gain."""
    gain_of = lambda a, b: a * a / (b + weight)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p, (a, b) in enumerate(parts):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = np.where((hl >= least) & (hr >= least), gain_of(gl, hl) + gain_of(gr, hr) - gain_of(gl + gr, hl + hr), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), p, a + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + weight)
    return out


def quarters(g: np.ndarray, h: np.ndarray, weight: float = 1.0, least: float = 2.0) -> tuple[float, np.ndarray]:
    """The gain and the values of the best cut of a grid of bins into four, one cut for each side."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def blocks(c):
        a, r, b, t = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.array([a, r - a, b - a, t - r - b + a])

    gs, hs = blocks(cg), blocks(ch)
    gain = (gs**2 / (hs + weight)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + weight)
    gain = np.where((hs >= least).sum(0) >= 3, gain, 0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = -gs[:, i, j] / (hs[:, i, j] + weight)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, cycles: int = 300, rate: float = 0.1, patience: int = 12) -> Gam:
    """x: features of the rows, y: 0 or 1, aside: the rows that tell when to stop.

    Without both labels among the others: a constant, their share.
    """
    y = np.asarray(y, float)
    own, goal = y[~aside], y[aside]
    model = Gam(float(np.log((own.sum() + 0.5) / (len(own) - own.sum() + 0.5))))
    if len(set(own)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[~aside, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    bins = model.bins(x)
    coarse = bins * PAIR_BINS // BINS
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(logit[~aside])
        return p - own, p * (1 - p)

    def loss() -> float:
        z, t = (logit[aside], goal) if len(goal) else (logit, y)
        return float((np.logaddexp(0, z) - t * z).mean())

    def boost(cycle, tables: list[np.ndarray]) -> None:
        """Runs cycles until the rows set aside lose; the tables are left as they were best."""
        nonlocal logit
        best = (loss(), [t.copy() for t in tables], logit.copy(), 0)
        for k in range(1, cycles + 1):
            cycle()
            if (now := loss()) < best[0] - 1e-6:
                best = (now, [t.copy() for t in tables], logit.copy(), k)
            elif k - best[3] >= patience:
                break
        for t, b in zip(tables, best[1], strict=True):
            t[:] = b
        logit = best[2]

    def features() -> None:
        for t, b in zip(model.tables, bins, strict=True):
            g, h = slopes()
            step = rate * tree(np.bincount(b[~aside], g, BINS), np.bincount(b[~aside], h, BINS))
            t += step
            logit[:] += step[b]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        cell = coarse[i, ~aside] * PAIR_BINS + coarse[j, ~aside]
        return quarters(*(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)))

    def pairs() -> None:
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            step = rate * grid(i, j)[1]
            t += step
            logit[:] += step[coarse[i], coarse[j]]

    boost(features, model.tables)
    ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda p: (-grid(*p)[0], p))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    boost(pairs, model.pair_tables)
    return model


def bucket(key: Column, n: int) -> Column:
    """crc32 of a key's text mod n; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def _measured(rows: DataFrame) -> DataFrame:
    """(key, label, x) of (key, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([measure(t) for t in texts], pa.list_(pa.float64()))], ["key", "label", "x"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, out_fold: int = 1, key: str = "doc_id", text: str = "text", label: str = "quality") -> Gam:
    """The model of a bounded sample of labelled rows outside the held-out fold.

    Labels other than 0 and 1, and those without a key or a row, are left out. A key with several
    labels has the largest; of rows that repeat a key the one with the smallest
    features counts. A quarter of the keys, by their hashes, tells when to stop. No labels: a constant of one half.
    """
    chosen = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull()).groupBy(labels[key].alias("key")).agg(F.max(labels[label]).cast("int").alias("label"))
    chosen = chosen.where(bucket(F.col("key"), folds) != out_fold).orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = _measured(texts.join(F.broadcast(chosen), "key").select("key", "label", "text"))
    rows = rows.groupBy("key").agg(F.max("label").alias("label"), F.min("x").alias("x"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, x, y) for b in batches for k, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        aside = np.array([zlib.crc32(f"aside {k}".encode()) % 4 == 0 for k, _, _ in got], bool)
        x = np.array([x for _, x, _ in got], float).reshape(len(got), len(FEATURES))
        model = fit(x, np.array([y for *_, y in got], float), aside)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(one, "model binary").first()
    return pickle.loads(found.model) if found else Gam(0.0)


def score(docs: DataFrame, model: Gam, folds: int = 3, out_fold: int = 1, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each row, from its whole text alone.

    A null text is an empty one and gets a score like any other; repeated rows are scored each; a
    null key is in no fold. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                s = model.score(np.array([measure(t) for t in texts], float).reshape(len(texts), len(FEATURES)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    found = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, predicted int")
    held = F.coalesce(bucket(F.col("key"), folds) == out_fold, F.lit(False))
    return found.select(F.col("key").alias(key), held.alias("held_out"), "score", "predicted")
