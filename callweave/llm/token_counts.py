"""Token counts of texts by rank-synchronous merging of byte-pair symbols in ragged arrays."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from callweave.llm.common import merged, slices, spread

#: How the byte-level pre-tokeniser cuts a text (fixed by the vocabulary).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Bytes of a pre-token beyond which it is merged by itself, as rounds over all symbols take time with its square.
LONG = 1000


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Byte-pair merges of a vocabulary file, applied to many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        names = byte_names()
        self.start = np.array([vocab[c] for c in names], np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into[order]
        self.whole = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile(PRETOKEN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.whole, key=len, reverse=True)))) if self.whole else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols, flat, and how many each sequence has. Sequences of over LONG bytes are merged by themselves."""
        long = [i for i, s in enumerate(sequences) if len(s) > LONG]
        sym, n = self.rounds([b"" if len(s) > LONG else s for s in sequences] if long else sequences)
        if not long:
            return sym, n
        parts = np.split(sym, np.cumsum(n)[:-1])
        for i in long:
            parts[i] = np.array(merged(self.start[np.frombuffer(sequences[i], np.uint8)].tolist(), self.pairs, self.n)[0], np.int64)
            n[i] = len(parts[i])
        return np.concatenate(parts), n

    def rounds(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols, flat, and how many each sequence has, all sequences a step at a time.

        Each round finds the lowest rank among the pairs of every sequence that still has one and
        merges all its occurrences, from the left where they overlap; the sequences advance
        together and leave when none of their pairs has a rank.
        """
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        sym = self.start[np.frombuffer(b"".join(sequences), np.uint8)]
        seq = np.repeat(np.arange(len(sequences)), sizes)
        done_sym, done_seq = [], []
        while len(sym) > 1:
            inside = seq[:-1] == seq[1:]
            at = np.full(len(sym), -1, np.int64)
            at[:-1][inside] = self.lookup(sym[:-1][inside], sym[1:][inside])
            rank = np.where(at >= 0, self.rank[at], np.iinfo(np.int64).max)
            first = np.flatnonzero(np.r_[True, ~inside])
            low = np.minimum.reduceat(rank, first)
            which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sym)]))
            active = (low < np.iinfo(np.int64).max)[which]
            if not active.all():
                done_sym.append(sym[~active])
                done_seq.append(seq[~active])
                sym, seq, at, rank, low_here = sym[active], seq[active], at[active], rank[active], low[which[active]]
                if not len(sym):
                    break
            else:
                low_here = low[which]
            hit = np.flatnonzero((at >= 0) & (rank == low_here))
            # of a run of overlapping hits every second one counts, from its first
            run = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            sym[hit] = self.into[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        sym, seq = np.concatenate([sym, *done_sym]), np.concatenate([seq, *done_seq])
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(sequences))

    def counts(self, texts: Iterable[str | None], known: dict[str, int]) -> list[int]:
        """Tokens of each text; ``known`` remembers the counts of pre-tokens."""
        parts, extra = [], []
        for t in texts:
            t = t or ""
            n = 0
            if self.specials and any(s in t for s in self.whole):
                pieces = self.specials.split(t)
                n = len(pieces) - 1
                parts.append([x for p in pieces for x in self.cut.findall(p)])
            else:
                parts.append(self.cut.findall(t))
            extra.append(n)
        new = set().union(*parts).difference(known) if parts else set()
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set().union(*parts)
            new = list(new)
            known.update(zip(new, self.merge([x.encode() for x in new])[1].tolist(), strict=True))
        return [sum(map(known.__getitem__, p)) + n for p, n in zip(parts, extra, strict=True)]


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    Special strings of the vocabulary count as one token each, as its library has it; no begin or
    end tokens. A null or empty text has 0 bytes and tokens. Repeated rows are counted each; other
    columns are ignored, whatever their names. Workers hold one run of about a million characters
    and a bounded table of known pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for rows, texts in slices(batch):
                n = merger(path).counts(texts, known)
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
