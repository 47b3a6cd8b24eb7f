"""Language of texts: a linear-chain conditional random field labels every word.

A word's emission scores are sums of learned weights of its hashed affixes, character n-grams and,
if it is in the learned lexicon, the word itself; transitions between labels are learned with them.
Sequences are the lines of a text, cut every ``CHAIN`` words so that a batch of any lines takes a
bounded number of steps. Forward-backward gives each word's marginals, and a text's language is
the label with the largest mean marginal over its words.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices, spread

#: Bits of the feature hash; words of a chain; lines and lexicon that the model is fitted with at most.
BITS, CHAIN, SAMPLE, LEXICON = 16, 256, 6000, 20_000
#: Words whose emissions a worker remembers before it starts afresh.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")
#: The answer for texts without a letter.
NONE = "und"


def features(words: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words, flat, and how many each has.

    Prefixes and suffixes of one to three characters, all character bigrams and trigrams of the
    bounded word, and the word itself if the lexicon has it.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounded = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, bounded), np.int64, len(words))
    c = np.frombuffer("".join(bounded).encode("utf-32-le"), np.uint32)
    which = np.repeat(np.arange(len(words)), size)
    left = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    right = np.repeat(size, size) - 1 - left
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
    four = three[:-1] * np.uint32(0xC2B2AE3D) + c[3:]
    found = []
    for kind, (h, n) in enumerate(((two, 2), (three, 3))):
        inside = right[: len(h)] >= n - 1
        found.append((h[inside] ^ np.uint32(kind * 0x27D4EB2F + 1), which[: len(h)][inside]))
    for kind, (h, n) in enumerate(((two, 2), (three, 3), (four, 4))):
        start = (left[: len(h)] == 0) & (right[: len(h)] >= n - 1)
        ends = right[: len(h)] == n - 1
        for salt, at in ((0x165667B1, start), (0x5851F42D, ends)):
            found.append((h[at] ^ np.uint32(salt + kind), which[: len(h)][at]))
    known = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
    found.append((np.array([zlib.crc32(words[i].encode()) ^ 0x3C6EF372 for i in known], np.uint32), known))
    h = np.concatenate([x for x, _ in found])
    w = np.concatenate([x for _, x in found])
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS)
    order = np.argsort(w, kind="stable")
    return h[order].astype(np.int64), np.bincount(w, minlength=len(words))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    trans: np.ndarray  # labels x labels, scores
    start: np.ndarray
    lexicon: set[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        at, n = features(words, self.lexicon)
        if not len(at):
            return np.zeros((len(words), len(self.labels)), np.float32)
        return np.add.reduceat(self.weights[at], np.cumsum(n) - n).astype(np.float32)[:, : len(self.labels)]

    def dump(self) -> bytes:
        return json.dumps([self.labels, self.trans.tolist(), self.start.tolist(), sorted(self.lexicon)]).encode()

    @classmethod
    def load(cls, head: bytes, weights: bytes) -> Model:
        labels, trans, start, lexicon = json.loads(head)
        return cls(labels, np.frombuffer(weights, np.float32).reshape(-1, max(1, len(labels))), np.array(trans), np.array(start), set(lexicon))


def chains(text: str) -> list[list[str]]:
    """The lower-cased words of each line, cut every CHAIN words."""
    out = []
    for line in text.lower().split("\n"):
        w = WORD.findall(line)
        out += [w[i : i + CHAIN] for i in range(0, len(w), CHAIN)]
    return out


def marginals(emit: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over many chains, laid end to end, one step of all of them at a time.

    Returns the marginals of every word and, with ``pairs``, the summed marginals of adjacent
    labels and of the first ones, and the log-likelihood's normaliser summed over the chains.
    """
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than t
    e = np.exp(emit - emit.max(1, keepdims=True))
    a, first = np.exp(trans), np.exp(start)
    alpha, scale = np.empty_like(e, dtype=np.float64), np.ones(len(e))
    prev = None
    for t in range(steps):
        at = begin[: live[t]] + t
        x = (first if t == 0 else prev[: live[t]] @ a) * e[at]
        s = x.sum(1)
        prev = x / s[:, None]
        alpha[at], scale[at] = prev, s
    gamma = np.empty_like(alpha)
    beta = np.ones((len(size), len(start)))
    joint = np.zeros_like(a)
    for t in range(steps - 1, -1, -1):
        at = begin[: live[t]] + t
        if t + 1 < steps and live[t + 1]:
            n = live[t + 1]
            nxt = begin[:n] + t + 1
            b = beta[:n] * e[nxt] / scale[nxt][:, None]
            if pairs:
                joint += a * (alpha[at[:n]].T @ b)
            beta[:n] = b @ a.T
        g = alpha[at] * beta[: live[t]]
        gamma[at] = g / g.sum(1, keepdims=True)
    if pairs:
        return gamma, joint, gamma[begin].sum(0) if steps else np.zeros(len(start)), float(np.log(scale).sum() + emit.max(1).sum())
    return gamma


def fit(rows: list[tuple[str, str]], labels: list[str], epochs: int = 4, rate: float = 0.1, batch: int = 500, decay: float = 1e-4) -> Model:
    """rows: (line, language); the lines' words all bear their text's language."""
    n = len(labels)
    lines = [(c, labels.index(y)) for t, y in rows for c in chains(t)]
    seen = Counter(w for c, _ in lines for w in c)
    lexicon = {w for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    model = Model(labels, np.zeros((1 << BITS, max(1, n)), np.float32), np.zeros((n, n)), np.zeros(n), lexicon)
    if n < 2 or not lines:
        return model
    vocab = {w: i for i, w in enumerate(seen)}
    at, count = features(list(vocab), lexicon)
    starts = np.r_[0, np.cumsum(count)]
    # lines of each language weigh the same together
    share = np.bincount([y for _, y in lines], [len(c) for c, _ in lines], n)
    weight = np.divide(share.sum() / n, share, out=np.zeros(n), where=share > 0)
    w, v = np.zeros((1 << BITS, n)), np.full((1 << BITS, n), 1e-8)
    head, hv = np.zeros((n + 1, n)), np.full((n + 1, n), 1e-8)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(lines))
        for lo in range(0, len(lines), batch):
            part = [lines[i] for i in order[lo : lo + batch]]
            size = np.array([len(c) for c, _ in part])
            ids = np.fromiter((vocab[x] for c, _ in part for x in c), np.int64, int(size.sum()))
            own, back = np.unique(ids, return_inverse=True)
            k = starts[own + 1] - starts[own]
            fat = at[np.arange(k.sum()) + np.repeat(starts[own] - (np.cumsum(k) - k), k)]
            emit = np.add.reduceat(w[fat], np.cumsum(k) - k)[back]
            y = np.repeat([y for _, y in part], size)
            gamma, joint, first, _ = marginals(emit, size, head[:n], head[n], pairs=True)
            truth = np.eye(n)[y]
            d = (gamma - truth) * weight[y][:, None] / len(ids)
            per_word = np.stack([np.bincount(back, d[:, j], len(own)) for j in range(n)], 1)
            spread_out = np.repeat(per_word, k, axis=0)
            touched, inv = np.unique(fat, return_inverse=True)
            g = np.stack([np.bincount(inv, spread_out[:, j], len(touched)) for j in range(n)], 1) + decay * w[touched] / len(ids)
            v[touched] += g * g
            w[touched] -= rate * g / np.sqrt(v[touched])
            same = np.diag(np.bincount([y for _, y in part], np.maximum(size - 1, 0), n))
            gh = np.vstack([joint - same, first - np.bincount([y for _, y in part], minlength=n)]) / len(ids)
            hv += gh * gh
            head -= rate * gh / np.sqrt(hv)
    model.weights, model.trans, model.start = w.astype(np.float32), head[:n], head[n]
    return model


def held_out(key: F.Column) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """The model of a bounded sample of lines of texts that aren't held out.

    The sample holds, for each label, the lines with the smallest hashes of key and place, about
    ``sample`` lines in all and one of each label at least; a line gives all its chains. Every label
    of the table can be predicted: their number isn't bounded here, but is that of languages. Rows
    without key, text or label don't take part.
    """
    known = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[label].alias("label")).where(F.col("text").isNotNull() & F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    labels = [r.label for r in known.groupBy("label").count().select("label").orderBy("label").collect()]
    lines = known.select("key", "label", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("line rlike '[\\\\p{L}]'")
    # drawn by a threshold on a hash that is the same share of every label's lines or more
    n = {r.label: r["count"] for r in lines.groupBy("label").count().where(F.col("label").isin(labels)).collect()} if labels else {}
    each = max(1, sample // max(1, len(labels)))
    draw = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(float(min(1.0, 1.3 * each / max(1, n.get(k, 0)) + 0.0))))]) if labels else F.create_map(F.lit(""), F.lit(0.0))
    h = F.pmod(F.xxhash64("key", "at"), F.lit(1 << 30)) / float(1 << 30)
    drawn = lines.where(h < draw[F.col("label")]).select("key", "at", "label", "line").orderBy(F.xxhash64("key", "at"), "key", "at").limit(2 * sample)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(k, a, t, y) for b in batches for k, a, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        m = fit([(t, y) for _, _, t, y in rows], labels)
        yield pa.RecordBatch.from_arrays([pa.array([m.dump()]), pa.array([m.weights.tobytes()])], ["head", "weights"])

    r = drawn.repartition(1).mapInArrow(one, "head binary, weights binary").first()
    return Model.load(bytes(r.head), bytes(r.weights)) if r else fit([], labels)


class Tagger:
    """A model with the emissions of the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model.labels)), np.float32)

    def tag(self, texts: list[str | None]) -> list[tuple[list[list[str]], np.ndarray]]:
        """Chains of words and the marginals of the words of each text."""
        parts = [chains(t or "") for t in texts]
        every = set().union(*(c for p in parts for c in p)) if parts else set()
        new = every.difference(self.at)
        if len(self.at) + len(new) > REMEMBERED:
            self.forget()
            new = every
        if new:
            new = list(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.emit = np.vstack([self.emit, self.model.emissions(new)])
        size = np.array([len(c) for p in parts for c in p], np.int64)
        get = self.at.__getitem__
        ids = np.fromiter((get(w) for p in parts for c in p for w in c), np.int64, int(size.sum()))
        n = len(self.model.labels)
        gamma = marginals(self.emit[ids], size, self.model.trans, self.model.start) if len(ids) and n else np.zeros((len(ids), n))
        ends = np.cumsum([sum(map(len, p)) for p in parts])
        return [(p, gamma[e - sum(map(len, p)) : e]) for p, e in zip(parts, ends, strict=True)]


def label_words(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_no, word, lang, score): the most likely label of every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for rows, texts in slices(batch):
                out = []
                for k, (p, g) in zip(rows.column(0).to_pylist(), tagger.tag(texts), strict=True):
                    best = g.argmax(1) if g.shape[1] else []
                    out += [(k, i, w, model.labels[best[i]], float(g[i, best[i]])) for i, w in enumerate(w for c in p for w in c)] if len(best) else []
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], rows.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], ["key", "word_no", "word", "lang", "score"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, word_no int, word string, lang string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, n_langs): every text's language.

    The score is the mean marginal of the language over the text's words; n_langs counts the
    languages that are likeliest for a tenth of the words or more. A null text and one without a
    letter get ``und``, score 0. A row with a null key isn't held out. With one learned language every text with a
    letter gets it; with none, ``und``. Ties go to the first language by name. Repeated rows are labelled each;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for rows, texts in slices(batch):
                lang, score, several = [], [], []
                for p, g in tagger.tag(texts):
                    # numerals such as superscripts count as word characters, but aren't letters
                    if not g.shape[1] or not any(c.isalpha() for x in p for w in x for c in w):
                        lang.append(NONE)
                        score.append(0.0)
                        several.append(0)
                        continue
                    mean = g.mean(0)
                    lang.append(model.labels[int(mean.argmax())])
                    score.append(min(1.0, float(mean.max())))
                    several.append(int((np.bincount(g.argmax(1), minlength=g.shape[1]) >= 0.1 * len(g)).sum()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(several, pa.int32())], ["key", "held_out", "lang_pred", "score", "n_langs"])

    rows = spread(docs.select(docs[key].alias("key"), F.coalesce(held_out(docs[key]), F.lit(False)).alias("held_out"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_langs int").withColumnRenamed("key", key)
