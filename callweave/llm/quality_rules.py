"""Quality rules: counts with fixed limits, and a calibrated classifier over hashed n-grams.

The classifier is a logistic regression over two blocks of hashed features, word unigrams and
bigrams and character trigrams and 4-grams, each as shares of its block, so that a text's logit is
the mean weight of its n-grams and a batch is scored by gathering weights. It is fitted in one task
on a documented, bounded sample of labelled rows (the smallest hashes of their keys), and its
logits are calibrated (Platt) on the quarter of the sample that the fit doesn't see.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices, spread

#: Bits of the hash of each block.
BITS = 17
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 3000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class Text:
    """What both the rules and the features need of a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    word_hash: np.ndarray
    chars: np.ndarray


def measure(text: str | None) -> Text:
    text = text or ""
    words = text.encode().split()
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lines = [x for x in text.encode().split(b"\n") if x.strip()] if "\n" in text else []
    return Text(
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, BLANKS)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated(seq, len(ids)),
        word_hash=np.fromiter(map(zlib.crc32, ids), np.uint32, len(ids))[seq],
        chars=np.frombuffer(text.encode("utf-32-le"), np.uint32),
    )


def repeated(seq: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words in windows of ``width`` that occur twice or more, the first included."""
    n = len(seq) - width + 1
    if n < 2:
        return 0
    key = seq[:n]
    for k in range(1, width):
        key, distinct_key = key * distinct + seq[k : k + n], distinct ** (k + 1)
        if distinct_key * distinct > 2**62:
            key = np.unique(key, return_inverse=True)[1]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = (count > 1)[where]
    covered = np.zeros(len(seq), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS) if BITS < 32 else h


def word_buckets(t: Text) -> np.ndarray:
    w = t.word_hash
    return np.r_[_mix(w), _mix(w[:-1] * np.uint32(0x9E3779B1) + w[1:])]


def char_buckets(t: Text) -> np.ndarray:
    c = t.chars * np.uint32(0x85EBCA77)
    three = (c[:-2] * np.uint32(31) + c[1:-1]) * np.uint32(0x01000193) + c[2:] if len(c) > 2 else c[:0]
    four = three[:-1] * np.uint32(0xC2B2AE3D) + c[3:] if len(c) > 3 else c[:0]
    return np.r_[_mix(three), _mix(four ^ np.uint32(0x5BD1E995))]


@dataclass
class Classifier:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, t: Text) -> float:
        w, c = word_buckets(t), char_buckets(t)
        return self.bias + (float(self.words[w].mean()) if len(w) else 0.0) + (float(self.chars[c].mean()) if len(c) else 0.0)

    def probability(self, t: Text) -> float:
        return float(_sigmoid(self.slope * self.logit(t) + self.shift))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, bool]], steps: int = 80, rate: float = 0.5, decay: float = 1e-5) -> Classifier:
    """rows: (label, buckets, shares, held out). Without both labels: a constant with their share."""
    size = 2 << BITS
    y = np.array([r[0] for r in rows], float)
    constant = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    flat = Classifier(np.zeros(size // 2, np.float32), np.zeros(size // 2, np.float32), 0.0, 0.0, constant)
    out = np.array([r[3] for r in rows], bool)
    if len(set(y[~out])) < 2:
        return flat

    def matrix(which):
        part = [rows[i] for i in np.flatnonzero(which)]
        n = np.array([len(r[1]) for r in part])
        return np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part]), np.repeat(np.arange(len(part)), n), len(part)

    at, share, row, n = matrix(~out)
    goal = y[~out]
    weight = np.where(goal == 1, 0.5 / goal.sum(), 0.5 / (len(goal) - goal.sum()))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, steps + 1):
        g = weight * (_sigmoid(np.bincount(row, share * w[at], n) + b) - goal)
        grad, gb = np.bincount(at, share * g[row], size) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        w -= scale * m / (np.sqrt(v) + 1e-9)
        b -= 0.1 * scale * mb / (np.sqrt(vb) + 1e-9)
    model = Classifier(w[: size // 2].astype(np.float32), w[size // 2 :].astype(np.float32), float(b), 1.0, 0.0)
    if len(set(y[out])) == 2:
        at, share, row, n = matrix(out)
        model.slope, model.shift = platt(np.bincount(row, share * w[at], n) + b, y[out])
    return model


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over the logits x, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * x + b
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-3 * a * a)

    for _ in range(60):
        p = _sigmoid(a * x + b)
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * x).sum() + 2e-3 * a, d.sum()])
        hess = np.array([[(h * x * x).sum() + 2e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """The classifier of a bounded sample of labelled rows, fitted in one task.

    Labels other than 0 and 1, and labels without a text, are left out; of repeated keys the largest
    label and the text of the smallest hash count. The sample is the ``sample`` labels with the smallest hashes of their keys.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in slices(batch):
                at, share = [], []
                for t in map(measure, found):
                    a, s = [], []
                    for k, buckets in enumerate((word_buckets(t), char_buckets(t))):
                        u, n = np.unique(buckets, return_counts=True)
                        a.append(u.astype(np.int32) + (k << BITS))
                        s.append((n / max(1, len(buckets))).astype(np.float32))
                    at.append(np.concatenate(a))
                    share.append(np.concatenate(s))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["key", "label", "at", "share"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {}
        for b in batches:
            for k, y, a, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                got[k] = (y, np.asarray(a.values), np.asarray(s.values).astype(float), zlib.crc32(str(k).encode()) % 4 == 0)
        m = fit([got[k] for k in sorted(got)])
        yield pa.RecordBatch.from_arrays([pa.array([m.words.tobytes()]), pa.array([m.chars.tobytes()]), *(pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.shift))], ["words", "chars", "bias", "slope", "shift"])

    kinds = dict(rows.dtypes)
    hashed = rows.mapInArrow(features, f"key {kinds['key']}, label {kinds['label']}, at array<int>, share array<float>")
    r = hashed.repartition(1).mapInArrow(one, "words binary, chars binary, bias double, slope double, shift double").first()
    if r is None:
        return fit([])
    return Classifier(np.frombuffer(r.words, np.float32), np.frombuffer(r.chars, np.float32), r.bias, r.slope, r.shift)


def keep_rows(docs: DataFrame, model: Classifier, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, text: str = "text") -> DataFrame:
    """The rows of docs that apply_rules keeps, unchanged, without a shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(pa.RecordBatch.from_arrays(batch.columns, [str(i) for i in range(batch.num_columns)]), str(at)):
                kept = [not _base_failed(t, min_words, max_repeat) and model.probability(t) >= threshold for t in map(measure, texts)]
                yield pa.RecordBatch.from_arrays(rows.filter(pa.array(kept, pa.bool_())).columns, batch.schema.names)

    return spread(docs).mapInArrow(run, docs.schema)


def _base_failed(t: Text, min_words: int, max_repeat: int) -> bool:
    return t.n_words < min_words or 100 * t.n_repeat_words > max_repeat * t.n_words


def apply_rules(docs: DataFrame, model: Classifier, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality).

    Every row is scored on its whole text; null and empty texts count as no words, fail the base
    rule and score the classifier's bias. Repeated rows are scored each. Other columns are ignored,
    whatever their names. ``max_repeat`` is in per cent of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                out = []
                for t in map(measure, texts):
                    failed = _base_failed(t, min_words, max_repeat)
                    p = model.probability(t)
                    out.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and p >= threshold, p))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names)

    names = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {kinds}").withColumnRenamed("key", key)
