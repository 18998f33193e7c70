"""Token-id files with canonical length-limited Huffman codes (operator 10).

Ids are counted over all texts; package-merge gives each id a code of at most
``LONGEST`` bits, and canonical order gives the codes, so a file needs only the code
lengths. A file is a head (the lengths) and blocks. A block holds whole texts,
each starting on a byte, with the bit offset of every ``STRIDE``-th token as a checkpoint; all
checkpoints of a block are decoded side by side with one table look-up a token.

Layout, little-endian: every record is ``magic, u32 size of the rest, rest``; the last byte of
the rest is a line feed. Head ("LXHD"): zlib of the lengths, one byte an id. Block
("LXBK"): u32 texts, u64 bytes of codes; i64 keys; u8 marks of null keys; u32 tokens of each
text; u64 bit offsets of the checkpoints; the codes, most significant bit first.

The counts come from a first pass that leaves the ids, packed, in the shared folder; the
second pass orders them by key (a range exchange, no single task) and writes.
Files appear by Spark's commit protocol. Null texts count as empty; long ones are read whole, each in one block; rows with a null key come first;
rows of equal keys are kept each, in the order of their packed ids' lengths and hashes, and spread over files like others. Empty tables give no rows. Other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, common

VOCABULARY = "byte_bpe_50k.json"
LONGEST, STRIDE = 18, 256
#: Bytes of packed ids that make a file, tokens that make a block.
FILE_BYTES, BLOCK_TOKENS = 16 << 20, 500_000
HEAD, BLOCK = b"LXHD", b"LXBK"


# -- codes ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Per level the merged list of leaves and packages: which entries are leaves tells all.
    levels: list[np.ndarray] = []
    row, is_leaf = weights, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(longest - 1):
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        merged = np.concatenate([weights, packages])
        ranks = np.argsort(merged, kind="stable")
        row, is_leaf = merged[ranks], ranks < n
        levels.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, before = 0, 0
    sizes = lengths[order].astype(int)
    for bits in range(1, int(sizes.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        own = order[sizes == bits]
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code += len(own)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.bits = int(self.lengths.max(initial=0))
        # Id and length of the code that begins each string of ``bits`` bits.
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.bits - self.lengths[order].astype(np.int64))
        table = np.repeat(order.astype(np.uint32) << np.uint32(5) | self.lengths[order], spans)
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.table[: len(table)] = table

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Codes of texts of ``counts`` ids each, starting on a byte each, and the bit offsets of the checkpoints."""
        sizes = self.lengths.take(ids).astype(np.int64)
        ends = np.cumsum(sizes)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], ends])
        bits = total[bounds[1:]] - total[bounds[:-1]]
        padded = (bits + 7) // 8 * 8
        begins = np.concatenate([[0], np.cumsum(padded)])
        at = ends - sizes + np.repeat(begins[:-1] - total[bounds[:-1]], counts)
        words = np.zeros(int(begins[-1]) // 32 + 2, np.uint64)
        if len(ids):
            value = self.codes.take(ids) << (64 - sizes - (at & 31)).astype(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        data = words.astype(">u4").tobytes()[: int(begins[-1]) // 8]
        return data, at[checkpoint_places(counts)]

    def decode(self, data: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of texts of ``counts`` ids each; all checkpoints go on side by side."""
        per = (counts + STRIDE - 1) // STRIDE
        todo = np.full(int(per.sum()), STRIDE, np.int64)
        lasts = np.cumsum(per)[per > 0] - 1
        todo[lasts] = (counts - (per - 1) * STRIDE)[per > 0]
        order = np.argsort(-todo, kind="stable")
        left, at = todo[order], checkpoints[order].astype(np.int64)
        target = checkpoint_places(counts)[order]
        out = np.empty(int(counts.sum()), np.uint32)
        raw = np.frombuffer(data + bytes(8), np.uint8)
        windows = np.zeros(len(raw) - 3, np.uint32)
        for k in range(4):
            windows |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
        mask, shift = np.uint32((1 << self.bits) - 1), 32 - self.bits
        active = len(left)
        for step in range(int(left.max(initial=0))):
            while active and left[active - 1] <= step:
                active = int(np.searchsorted(-left, -step, "left"))
            now = at[:active]
            found = self.table.take((windows.take(now >> 3) >> (shift - (now & 7)).astype(np.uint32)) & mask)
            out[target[:active] + step] = found >> np.uint32(5)
            now += found & np.uint32(31)
        return out


def checkpoint_places(counts: np.ndarray) -> np.ndarray:
    """Places (in all ids) of every STRIDE-th token of each text."""
    per = (counts + STRIDE - 1) // STRIDE
    begins = np.cumsum(counts) - counts
    return np.repeat(begins, per) + STRIDE * (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))


# -- records -------------------------------------------------------------------------------


def head_record(lengths: np.ndarray) -> bytes:
    rest = zlib.compress(lengths.tobytes(), 9) + b"\n"
    return HEAD + struct.pack("<I", len(rest)) + rest


def block_record(codec: Codec, keys: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    data, checkpoints = codec.encode(ids, counts)
    rest = b"".join([
        struct.pack("<IQ", len(keys), len(data)),
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], np.uint8).tobytes(),
        counts.astype("<u4").tobytes(),
        checkpoints.astype("<u8").tobytes(),
        data,
        b"\n",
    ])
    return BLOCK + struct.pack("<I", len(rest)) + rest


def read_records(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    view, at = memoryview(content), 0
    while at < len(content):
        magic, size = bytes(view[at : at + 4]), struct.unpack_from("<I", content, at + 4)[0]
        if magic not in (HEAD, BLOCK) or at + 8 + size > len(content):
            raise ValueError(f"no record at byte {at}")
        yield magic, view[at + 8 : at + 8 + size]
        at += 8 + size


def read_block(codec: Codec, rest: memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, numbers of ids and all ids of a block."""
    n, size = struct.unpack_from("<IQ", rest, 0)
    at = 12
    keys = np.frombuffer(rest, "<i8", n, at).tolist()
    null = np.frombuffer(rest, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(rest, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    points = int(((counts + STRIDE - 1) // STRIDE).sum())
    checkpoints = np.frombuffer(rest, "<u8", points, at)
    data = bytes(rest[at + 8 * points : at + 8 * points + size])
    return [None if z else k for k, z in zip(keys, null, strict=True)], counts, codec.decode(data, checkpoints, counts)


# -- jobs ----------------------------------------------------------------------------------


def _pack(ids: np.ndarray) -> bytes:
    """Low and high bytes of 16-bit halves apart, as that compresses better."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = 4 if planes[3].any() else 3 if planes[2].any() else 2
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    used = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u4").ravel()


@cache
def encoder() -> byte_bpe.ByteBpe:
    """The json file's vocabulary is that of the ranks; its special tokens count wherever their strings occur."""
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return byte_bpe.ByteBpe(special={t["content"]: t["id"] for t in added})


def encode_texts(df: DataFrame, end_id: int, key: str, text: str) -> DataFrame:
    """Rows of ``key``, ``packed`` ids with the end id; and rows with ``counts`` (i64 array as binary) of what a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = encoder(), np.zeros(0, np.int64)
        names = ["k", "packed", "counts"]
        for batch in common.slices(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in byte_bpe.groups(texts):
                ids, counts = bpe.encode_batch(texts[begin:end])
                bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
                tail = np.array([end_id], np.uint32)
                packed = [_pack(np.concatenate([ids[a:b], tail])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                more = np.bincount(ids, minlength=end_id + 1)
                more[end_id] += end - begin
                if len(more) > len(seen):
                    more[: len(seen)] += seen
                    seen = more
                else:
                    seen[: len(more)] += more
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), pa.array(packed, pa.binary()), pa.nulls(end - begin, pa.binary())], names=names)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names=names)

    return df.select(F.col(key).cast("bigint").alias("k"), text).mapInArrow(run, "k bigint, packed binary, counts binary")


def total_counts(tallies: DataFrame) -> np.ndarray:
    """The sum of tasks' counts. What reaches the driver is one number for each id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.frombuffer(x, "<i8")
                wide = np.zeros(max(len(total), len(own)), np.int64)
                wide[: len(total)] += total
                wide[: len(own)] += own
                total = wide
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = tallies.mapInArrow(spread, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(df: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write the files below ``path``; their names order them by key."""
    spark = df.sparkSession
    encoded = common.durable(encode_texts(df, end_id, key, text), "ids")
    lengths = code_lengths(total_counts(encoded.where("counts is not null").select("counts")))
    rows = encoded.where("packed is not null").select("k", "packed")
    size = rows.agg(F.sum(F.length("packed"))).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 1 << 20 else 1)
    # Bounds are sampled by Spark, so the order is by short keys. The last one parts equal rows; it is the same whenever the table is read.
    order = [F.asc_nulls_first("k"), F.length("packed"), "hash", "row"]
    hashed = rows.withColumns({"hash": F.xxhash64("packed"), "row": F.monotonically_increasing_id()})
    ordered = hashed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("k", "packed")
    shared = spark.sparkContext.broadcast(lengths.tobytes())  # a byte for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.uint8)
        codec, first = Codec(own), True
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> bytes:
            nonlocal first, held
            record = block_record(codec, keys, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))
            if first:
                record, first = head_record(own) + record, False
            keys.clear()
            ids.clear()
            held = 0
            return record

        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                ids.append(_unpack(packed.as_py()))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array([block()], pa.binary())], names=["record"])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([block()], pa.binary())], names=["record"])

    common.write_bytes(ordered.mapInArrow(blocks, "record binary"), "record", path, "\n")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all texts before), ``n_tokens``, ``ids_crc32`` of every text of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codec, at = None, 0
                number = int(name.rsplit("part-", 1)[1].split("-", 1)[0])
                for magic, rest in read_records(content.as_py()):
                    if magic == HEAD:
                        codec = Codec(np.frombuffer(zlib.decompress(rest[:-1]), np.uint8))
                        continue
                    keys, counts, ids = read_block(codec, rest)
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(bounds[:-1] + at), pa.array(counts), pa.array(sums, pa.int64())],
                        names=["file", key, "start", "n_tokens", "ids_crc32"],
                    )
                    at += int(bounds[-1])

    found = common.durable(common.read_files(spark, path).mapInArrow(run, f"file int, `{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"), "read")
    # One row a file: its first id's place in the whole.
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = totals.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    return found.join(before, "file").select(key, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` of every text of the files, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                codec = None
                for magic, rest in read_records(content.as_py()):
                    if magic == HEAD:
                        codec = Codec(np.frombuffer(zlib.decompress(rest[:-1]), np.uint8))
                        continue
                    keys, counts, ids = read_block(codec, rest)
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    return common.read_files(spark, path).mapInArrow(run, f"`{key}` bigint, ids array<int>")


__all__ = ["Codec", "canonical_codes", "code_lengths", "encode_texts", "ids_of", "read", "write"]
