"""Byte-level BPE encoding and decoding (operator 5).

Vectorised pre-tokenisation (``scan``) cuts texts into pieces; each distinct piece
is merged once per worker and remembered (bounded), and the ids of a whole batch are
gathered with numpy. Byte offsets of the tokens come with the ids; decoding gathers the
tokens' bytes. Works on any part of the rows alone, so tasks need no exchange.

Null texts count as empty; empty texts have no tokens. Texts of any length are cut at
places where a piece surely starts, so memory follows ``CHUNK``, not the longest text.
Repeated rows are encoded alike; empty tables give no rows; other columns, whatever their names, are not read. A text without white space, however long, is one
part, and takes memory in proportion. Merging one piece is the tiktoken library's own inner call, as it has no public one for it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import common, scan

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points that are worked on at once, and pieces that a worker remembers.
CHUNK, REMEMBERED = 1_000_000, 400_000
#: Pieces of up to SHORT bytes are looked up in a table of 2**SLOT_BITS places, PROBES of them at most.
SHORT, SLOT_BITS, PROBES = 7, 19, 4
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class _Pool:
    """Ids of the pieces that were merged, in the order of their first use."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self.merge, self.ids, self.ends = merge, [], [0]
        self._tables = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, piece: bytes) -> None:
        self.ids += self.merge(piece)
        self.ends.append(len(self.ids))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The pool of ids, and where each piece's end."""
        ids, ends = self._tables
        if len(ends) < len(self.ends):
            ids = np.concatenate([ids, np.array(self.ids[len(ids) :], np.uint32)])
            ends = np.concatenate([ends, np.array(self.ends[len(ends) :], np.int64)])
            self._tables = ids, ends
        return self._tables


class _Known(dict):
    def __init__(self, learn: Callable[[bytes], None]):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: bytes) -> int:
        self.learn(piece)
        self[piece] = at = len(self)
        return at


class Slots:
    """An open hash table over numpy arrays: keys (64-bit numbers other than 0) to numbers that aren't negative."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those that aren't there."""
        at = self.places(keys)
        out = np.where(self.keys.take(at) == keys, self.values.take(at), -1)
        for step in range(1, PROBES):
            rest = np.flatnonzero(out < 0)
            if not len(rest):
                break
            again = (at[rest] + step) & ((1 << self.bits) - 1)
            out[rest] = np.where(self.keys.take(again) == keys[rest], self.values.take(again), -1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep what finds a free place; the rest stays unknown."""
        keys, first = np.unique(keys, return_index=True)
        for key, at, value in zip(keys, self.places(keys).tolist(), values[first].tolist(), strict=True):
            for step in range(PROBES):
                slot = (at + step) & ((1 << self.bits) - 1)
                if self.keys[slot] == key:
                    break
                if not self.keys[slot]:
                    self.keys[slot], self.values[slot] = key, value
                    self.used += 1
                    break


class PieceIndex:
    """Numbers pieces by first use, calling ``learn`` for each new one."""

    def __init__(self, learn: Callable[[bytes], None]):
        # Short pieces are packed into a number with their length.
        self._known, self._slots = _Known(learn), Slots(SLOT_BITS)

    def __len__(self) -> int:
        return len(self._known)

    def find(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece raw[starts[i] : ends[i]]."""
        lengths = ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        words = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))[starts[short]] if len(raw) else np.empty(0, np.uint64)
        keys = (words & _MASKS[lengths[short]]) | (lengths[short].astype(np.uint64) << np.uint64(56))
        out[short] = self._slots.find(keys)
        rest = np.flatnonzero(out < 0)
        pieces = map(raw.__getitem__, map(slice, starts[rest].tolist(), ends[rest].tolist()))
        out[rest] = np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(rest))
        new = np.flatnonzero(np.isin(short, rest, assume_unique=True)) if len(rest) else rest
        if len(new):
            self._slots.add(keys[new], out[short[new]])
        return out


def gather_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], ... starts[i] + lengths[i] - 1 for all i, joined."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return at


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + lengths[i]] for all i, joined."""
    return pool.take(gather_places(starts, lengths)) if len(starts) else pool[:0]


class ByteBpe:
    """Encodes as the tiktoken library's ``encode_ordinary`` with the same ranks and the 50k pattern.

    ``special``: strings that are one token wherever they occur, with their ids.
    """

    def __init__(self, path: str | None = None, special: dict[str, int] | None = None):
        self.ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
        merger = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._merge = merger._core_bpe.encode_single_piece
        self.special = special or {}
        words = {rank: word for word, rank in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        listed = [words.get(i, b"") for i in range(max(words) + 1)]
        self._bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.lengths = np.array([len(w) for w in listed], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._forget()

    def _forget(self) -> None:
        self._pool = _Pool(self._merge)
        self._index = PieceIndex(self._pool.learn)

    def _encode_points(self, raw: bytes, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated non-empty texts, and how many each has. raw: the same as UTF-8."""
        starts = scan.pieces_starts(points, ends, scan.with_spaces())
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
        if len(raw) == len(points):
            at = starts
        else:
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts]
        index = self._index.find(raw, at, np.append(at[1:], len(raw)))
        pool, bounds = self._pool.tables()
        begin, lengths = bounds.take(index), (bounds[1:] - bounds[:-1]).take(index)
        ids = gather(pool, begin, lengths)
        counts = np.add.reduceat(lengths, first) if len(first) else np.empty(0, np.int64)
        if len(self._index) > REMEMBERED:
            self._forget()
        return ids, counts

    def _parts(self, text: str) -> list[str]:
        """A long text cut where white space follows something else: there a piece starts whatever stands around."""
        parts, begin = [], 0
        while len(text) - begin > CHUNK:
            end = begin + CHUNK
            while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace() and ord(text[end]) not in range(0x1C, 0x20) and ord(text[end - 1]) not in range(0x1C, 0x20)):
                end += 1
            parts.append(text[begin:end])
            begin = end
        parts.append(text[begin:])
        return [p for p in parts if p]

    def _split_special(self, text: str) -> list[str | int]:
        parts: list[str | int] = [text]
        for word, number in self.special.items():
            if word in text:
                parts = [y for x in parts for y in ([x] if isinstance(x, int) else [z for s in x.split(word) for z in (s, number)][:-1])]
        return parts

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, as uint32, and the number of ids of each text."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        waiting: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                joined = "".join(waiting)
                ends = np.cumsum(np.fromiter(map(len, waiting), np.int64, len(waiting)))
                ids, each = self._encode_points(joined.encode("utf-8", "replace"), scan.code_points(joined), ends)
                out.append(ids)
                np.add.at(counts, owners, each)
                waiting.clear()
                owners.clear()
                size = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            for part in self._split_special(text):
                if isinstance(part, int):
                    flush()
                    out.append(np.array([part], np.uint32))
                    counts[k] += 1
                    continue
                for p in self._parts(part):
                    if size + len(p) > CHUNK:
                        flush()
                    waiting.append(p)
                    owners.append(k)
                    size += len(p)
        flush()
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), counts

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte position of each token's first byte in its text's UTF-8."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather(self._bytes, self._starts.take(ids), self.lengths.take(ids)).tobytes()


@cache
def encoder(path: str | None = None) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def groups(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` characters together."""
    begin = total = 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``ids`` (array of int), ``offsets`` (array of long, byte places of the tokens) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in common.slices(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in groups(texts):
                ids, counts = bpe.encode_batch(texts[begin:end])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                places = [bpe.offsets(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                flat = np.concatenate(places) if places else np.empty(0, np.int64)
                ends = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, end - begin), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int64)))],
                    names=[key, "ids", "offsets"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, offsets array<bigint>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key``, ``decoded`` (binary) of rows with an array of ids; null ids give empty bytes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            out = [bpe.decode_bytes(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass, keeping only digests.

    ``key``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded bytes).
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in common.slices(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in groups(texts):
                ids, counts = bpe.encode_batch(texts[begin:end])
                ids = ids.astype("<u4", copy=False)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                data = memoryview(bpe.decode_bytes(ids))
                sizes = np.concatenate([[0], np.cumsum(bpe.lengths.take(ids))])[bounds]
                raw = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(begin, end - begin),
                        pa.array(counts),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
