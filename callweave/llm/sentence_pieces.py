"""Offset-preserving SentencePiece encoding and decoding of byte-pair models.

Normalisation walks the text by the longest prefix in the model's compiled character map and keeps,
for every normalised byte, the original byte it came from; the segmentation then projects each
piece to the original bytes it covers. Segmentation merges, in every chunk at once, the leftmost of
the best-scored adjacent pairs, one a round, which is what the sequential algorithm does chunk by
chunk. Chunks are cut where no piece of the vocabulary can cross, so a text is a sequence of
(mostly short, mostly repeated) chunks whose pieces a worker remembers within a bound.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm.common import merged, slices, spread

SPACE = "▁"
#: Chunks and pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Characters of a chunk beyond which it is merged by itself, as rounds over all chunks take time with its square.
LONG = 1000
#: Kinds of piece in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """A compiled character map: a double-array trie over prefixes and a pool of replacements."""

    def __init__(self, blob: bytes):
        self.size = 0
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.pool = blob[4 + n :]
            self.size = len(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes covered, replacement) of the longest prefix of data[at:] in the map."""
        if not self.size:
            return None
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= self.size:
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:  # a key ends here
                best = (i + 1 - at, self.units[node] & (1 << 31) - 1)
        if best is None:
            return None
        start = best[1]
        return best[0], self.pool[start : self.pool.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


def _starts(data: bytes) -> np.ndarray:
    """Where the characters of UTF-8 bytes begin, and the end."""
    return np.r_[np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)]


class Model:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        self.read(proto)

    def read(self, proto) -> None:
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models with spaces as prefixes are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        if {USER_DEFINED, UNUSED} & set(self.kinds.tolist()):
            raise ValueError("user-defined or unused pieces aren't supported")
        self.unk = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.bos, self.eos = (self.pieces.index(p) if p in self.pieces else -1 for p in (proto.trainer_spec.bos_piece or "<s>", proto.trainer_spec.eos_piece or "</s>"))
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)]) if proto.trainer_spec.byte_fallback else None
        self.unk_surface = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else " ⁇ "
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        # single characters inside pieces are symbols too, even if they aren't pieces
        inside = sorted(set("".join(normal)) - set(normal))
        self.symbol = dict(normal) | {c: len(self.pieces) + i for i, c in enumerate(inside)}
        self.n = len(self.pieces) + len(inside) + 1
        pairs: dict[int, tuple[float, int]] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (proto.pieces[i].score, i)
        self.keys = np.array(sorted(pairs), np.int64)
        scores = np.array([pairs[k][0] for k in self.keys.tolist()])
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # lower is better, equal scores are equal
        # what pieces decode to, as bytes
        self.surface = [b"" if k == CONTROL else self.unk_surface.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds.tolist(), strict=True)]
        self.surface_at = np.r_[0, np.cumsum([len(s) for s in self.surface])]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        crossed = any(SPACE in p.lstrip(SPACE) for p in normal)
        several = {c for p in normal if len(p) > 1 for c in p}
        if crossed:
            self.chunk = re.compile(r"(?s).+")
        elif "\n" in several:
            self.chunk = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.chunk = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

    # -- normalisation -----------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and the original byte of each of its bytes and of its end.

        None instead of an alignment stands for the plain case: nothing but a leading space was
        added and spaces were escaped.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.size and not self.squeeze:
            if self.escape:
                text = text.replace(" ", SPACE)
            return (SPACE if self.escape else " ") * self.dummy + text, None
        data, out, at, src = text.encode(), [], 0, []
        starts = _starts(data)
        width = dict(zip(starts[:-1].tolist(), np.diff(starts).tolist(), strict=True))
        pieces = []
        while at < len(data):
            found = self.map.longest(data, at)
            n, new = found or (width.get(at, 1), data[at : at + width.get(at, 1)])
            pieces.append((at, n, new))
            at += n
        if self.squeeze:
            while pieces and not pieces[0][2].strip(b" "):
                pieces.pop(0)
        space = SPACE.encode() if self.escape else b" "
        if not pieces:
            return "", np.array([len(data)])
        if self.dummy:
            out.append(space)
            src += [pieces[0][0]] * len(space)
        was_space = self.squeeze
        for at, n, new in pieces:
            if self.squeeze and was_space:
                new = new.lstrip(b" ")
            if new:
                was_space = self.squeeze and new.endswith(b" ")
                made = new.replace(b" ", space)
                out.append(made)
                src += [at] * len(made)
            end = at + n
        flat = b"".join(out)
        if self.squeeze:
            while flat.endswith(space):
                flat = flat[: -len(space)]
                end = src[len(flat)]
                src = src[: len(flat)]
        return flat.decode(), np.array([*src, end], np.int64)

    # -- segmentation ------------------------------------------------------------------------

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all chunks, flat; bytes of the chunk that each covers; pieces per chunk."""
        long = [i for i, c in enumerate(chunks) if len(c) > LONG]
        ids, width, n = self.rounds(["" if len(c) > LONG else c for c in chunks] if long else chunks)
        if not long:
            return ids, width, n
        at = np.cumsum(n)[:-1]
        all_ids, all_width = np.split(ids, at), np.split(width, at)
        for i in long:
            sym, start = merged([self.symbol.get(c, self.n - 1) for c in chunks[i]], self.pairs, self.n)
            ends = _starts(chunks[i].encode())
            covers = np.diff(np.r_[ends[start], ends[-1]])
            all_ids[i], all_width[i], one = self._known(np.array(sym, np.int64), np.zeros(len(sym), np.int64), covers, np.array(start), chunks[i], 1)
            n[i] = one[0]
        return np.concatenate(all_ids), np.concatenate(all_width), n

    def rounds(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``segment`` gives, all chunks a merge at a time."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chars = "".join(chunks)
        unknown = self.n - 1
        get = self.symbol.get
        sym = np.fromiter((get(c, unknown) for c in chars), np.int64, len(chars))
        code = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        seq = np.repeat(np.arange(len(chunks)), sizes)
        width = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)
        start = np.arange(len(chars))
        done = []
        none = np.iinfo(np.int64).max
        rank = np.full(len(sym), none)
        into = np.zeros(len(sym), np.int64)
        self._pairs(sym, seq, rank, into, np.arange(max(0, len(sym) - 1)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            ends = low == none
            if ends.any():
                over = np.repeat(ends, count)
                done.append((sym[over], seq[over], width[over], start[over]))
                sym, seq, width, start, rank, into = (x[~over] for x in (sym, seq, width, start, rank, into))
                if not len(sym):
                    break
                low, count = low[~ends], count[~ends]
            hit = np.flatnonzero(rank == np.repeat(low, count))
            hit = hit[np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]]  # the leftmost of each chunk
            sym[hit] = into[hit]
            width[hit] += width[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, seq, width, start, rank, into = (x[keep] for x in (sym, seq, width, start, rank, into))
            self._pairs(sym, seq, rank, into, np.unique(np.r_[at, at - 1]))
        if done:
            sym, seq, width, start = (np.concatenate([d[k] for d in done]) for k in range(4))
            order = np.argsort(start, kind="stable")
            sym, seq, width, start = (x[order] for x in (sym, seq, width, start))
        return self._known(sym, seq, width, start, chars, len(chunks))

    def _pairs(self, sym, seq, rank, into, at) -> None:
        """Sets rank and into of the pairs that begin at the positions ``at``."""
        at = at[(at >= 0) & (at < len(sym))]
        rank[at] = np.iinfo(np.int64).max
        at = at[at + 1 < len(sym)]
        at = at[seq[at] == seq[at + 1]]
        key = sym[at] * self.n + sym[at + 1]
        if not len(self.keys):
            return
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[k] == key
        rank[at[ok]] = self.rank[k[ok]]
        into[at[ok]] = self.into[k[ok]]

    def _known(self, sym, seq, width, start, chars: str, n: int):
        """Symbols outside the vocabulary become bytes or the unknown piece."""
        odd = sym >= len(self.pieces)
        if not odd.any():
            return sym, width, np.bincount(seq, minlength=n)
        if self.byte_ids is None:
            # a run of unknown characters is one unknown piece
            sym = np.where(odd, self.unk, sym)
            joins = np.r_[False, odd[1:] & odd[:-1] & (seq[1:] == seq[:-1])]
            first = np.flatnonzero(~joins)
            return sym[first], np.add.reduceat(width, first), np.bincount(seq[first], minlength=n)
        times = np.where(odd, width, 1)
        raw = b"".join(chars[s].encode() for s in start[odd].tolist())
        out = np.repeat(sym, times)
        out[np.repeat(odd, times)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        wide = np.repeat(np.where(odd, 1, width), times)
        return out, wide, np.bincount(np.repeat(seq, times), minlength=n)

    # -- texts -------------------------------------------------------------------------------

    def encode(self, texts: list[str | None], known: Known) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and begin and end of each piece in the bytes of the original."""
        plain = [self.normalise(t or "") for t in texts]
        parts = [self.chunk.findall(t) for t, _ in plain]
        known.learn(self, parts)
        get = known.at.__getitem__
        for (norm, source), t, part in zip(plain, texts, parts, strict=True):
            which = np.fromiter(map(get, part), np.int64, len(part))
            ids, width = known.gather(which)
            end = np.cumsum(width)
            begin = end - width
            if source is None:
                # an escaped space has three bytes for one, and the first stands for none
                raw = np.frombuffer(norm.encode(), np.uint8)
                size = np.ones(len(raw) + 1, np.int64)
                if self.escape:
                    is_space = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
                    data = (" " * self.dummy + t).encode()
                    # marks that the original itself holds keep their three bytes
                    if SPACE in t:
                        char_at = np.searchsorted(_starts(raw.tobytes()), is_space)
                        real = np.array([c == SPACE for c in t], bool)
                        is_space = is_space[~real[np.maximum(char_at - self.dummy, 0)] | (char_at < self.dummy)]
                    size[is_space + 1] = 0
                    size[is_space + 2] = 0
                    source = np.minimum(np.maximum(np.r_[0, np.cumsum(size[:-1])] - self.dummy, 0), len(data) - self.dummy)
                else:
                    source = np.maximum(np.arange(len(raw) + 1) - self.dummy, 0)
            yield ids, source[begin], source[end]

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids; bytes that aren't UTF-8 become U+FFFD, one for each byte."""
        ids = np.asarray(ids, np.int64)
        kinds = self.kinds[ids]
        # runs of byte pieces, which controls interrupt, are decoded each by itself
        edges = np.flatnonzero(np.diff(np.r_[False, kinds == BYTE, False].astype(np.int8)))
        raw = _gather(self.surface_bytes, self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids])
        at = np.r_[0, np.cumsum(self.surface_at[ids + 1] - self.surface_at[ids])]
        spoken = ids[kinds != CONTROL]
        lead = 0
        if (self.dummy or self.squeeze) and len(spoken) and self.pieces[int(spoken[0])].startswith(SPACE):
            first = self.surface[int(spoken[0])]
            lead = len(first) - len(first.lstrip(b" ")) if self.squeeze and not self.dummy else 1
        raw = raw.tobytes()
        inner = (kinds[1:-1] == CONTROL).any() and len(edges)
        try:
            if not inner:
                return raw[lead:].decode()
        except UnicodeDecodeError:
            pass
        out, last = [], lead
        for lo, hi in at[edges].reshape(-1, 2).tolist():
            out += [raw[last:lo].decode(), _bytes(raw[lo:hi])]
            last = hi
        return "".join([*out, raw[last:].decode()])


def _bytes(raw: bytes) -> str:
    """Characters of a run of bytes, with U+FFFD for each byte that isn't part of one."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each row, joined."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return flat[:0]
    return flat[np.arange(total[-1]) + np.repeat(start - (total - size), size)]


class Known:
    """Pieces of the chunks seen so far, in flat arrays."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids = self.width = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def learn(self, model: Model, parts: list[list[str]]) -> None:
        every = set().union(*parts) if parts else set()
        new = every.difference(self.at)
        if not new:
            return
        if len(self.at) + len(new) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.__init__()
            new = every
        new = list(new)
        ids, width, n = model.segment(new)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(n)]
        self.ids, self.width = np.r_[self.ids, ids.astype(np.int32)], np.r_[self.width, width.astype(np.int32)]

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.start[which], self.start[which + 1] - self.start[which]
        total = np.cumsum(size)
        if not len(total) or not total[-1]:
            return self.ids[:0].astype(np.int64), self.width[:0].astype(np.int64)
        at = np.arange(total[-1]) + np.repeat(start - (total - size), size)
        return self.ids[at].astype(np.int64), self.width[at].astype(np.int64)


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, begin, end): ids with begin and end tokens, and the bytes of the text each covers.

    The begin and end tokens cover nothing. A null or empty text has just those two. Repeated rows
    are encoded each; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model(path), Known()
        for batch in batches:
            for rows, texts in slices(batch):
                ids, begin, end = [], [], []
                for t, (i, b, e) in zip(texts, m.encode(texts, known), strict=True):
                    last = len((t or "").encode())
                    ids.append(np.r_[m.bos, i, m.eos].astype(np.int32))
                    begin.append(np.r_[0, b, last].astype(np.int32))
                    end.append(np.r_[0, e, last].astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, begin, end))], ["key", "ids", "begin", "end"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, begin array<int>, end array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            found = [None if x is None else m.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["key", "text"])

    rows = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_span_bytes): encode, decode and digest in one pass.

    Ids are digested as little-endian 32-bit integers, the decoded text as UTF-8. n_span_bytes is
    how many bytes of the text the spans cover, counted once each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model(path), Known()
        for batch in batches:
            for rows, texts in slices(batch):
                n, a, b, covered = [], [], [], []
                for i, begin, end in m.encode(texts, known):
                    ids = np.r_[m.bos, i, m.eos]
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                    covered.append(int(np.maximum(end - np.maximum(begin, np.r_[0, end[:-1]]), 0).sum()) if len(i) else 0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(covered, pa.int64())], ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes"])

    rows = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long").withColumnRenamed("key", key)
