"""N-gram Jaccard join by MinHash banding (operator 2).

1. Each text becomes its set of word shingles; texts with equal sets are copies, and one of them stands for all.
2. MinHash: ``bands`` hashes of ``rows`` minima each, chosen so that a pair at the threshold meets in a band with the
   target probability. A shuffle on band hashes gives each bucket its smallest member; (member, smallest) are edges whose
   components hold every pair that shares a bucket.
3. Pairs are verified on full shingle sets, and put out never: a block of texts reports, for each of them, its number of links and the
   smallest text it is connected to. Intersections of a block are products of 0/1 matrices. Each pair is verified in one place:
   - a component that fits one block is verified where it is gathered, as a whole;
   - in a larger component, which may hang together by chance, a bucket of up to ``LIGHT`` texts is a block of its own (once, where several have the same members)
     and counts the pairs that share no band before its own;
   - larger buckets make components of their own. Their members are dealt into blocks of a bounded size by set size (sets that
     differ by more than the threshold allows never meet) and hash, and pairs of blocks are tiles, spread over tasks. They count the pairs whose first
     shared band is such a bucket, or that share none.
4. Components of the verified links are the classes.

So a class is a connected component of "similarity at least the threshold", and ``n_links`` counts the other documents at or above the
threshold, copies included. A hot group of n different near copies costs n * n / BLOCK_TEXTS rows of tiles; a chain of
chance meetings costs what its buckets hold.

Null and empty texts are sets of their own kind (see ``shingles``), so they are copies of each other. Rows with a
null key take no part. To ``join`` rows of one key are one document, and results have one row for each distinct key; ``keep_one`` tells
texts of one key apart. Texts are read whole, however long. Empty tables give no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components, shingles

SIZE, THRESHOLD, RECALL, MOST_HASHES = 5, Fraction(4, 5), 0.99999, 160
#: What a block of texts holds at most, about; texts of a bucket that is a block of its own; columns of a matrix at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, LIGHT, COLUMNS = 256, 250_000, 64, 4096


def banding(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """The most selective (bands, rows) with at most ``most`` hashes whose chance to meet, at the threshold, is ``recall``."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


class Bands:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factors = shingles.mixed(np.arange(1, bands * rows + 1, dtype=np.uint64), 77) | np.uint64(1)
        self.weights = shingles.mixed(np.arange(1, rows + 1, dtype=np.uint64), 99) | np.uint64(1)
        self.salts = shingles.mixed(np.arange(1, bands + 1, dtype=np.uint64), 55)

    def of(self, items: np.ndarray) -> np.ndarray:
        """The band hashes of a set, as int64."""
        least = None
        for begin in range(0, len(items), 512):
            own = (items[begin : begin + 512, None] * self.factors).min(axis=0)
            least = own if least is None else np.minimum(least, own)
        folded = (shingles.mixed(least).reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
        return shingles.mixed(folded ^ self.salts).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: Bands) -> DataFrame:
    """``k``, ``s`` (digest of the shingle set), ``n`` (its size), ``b`` (band hashes) of every row with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = [(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), len(u), bands.of(u)) for u in shingles.sets(part.column(1).to_pylist(), size)]
            ends = pa.array(np.arange(0, len(found) * bands.bands + 1, bands.bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([s for s, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([b for _, _, b in found])))],
                names=["k", "s", "n", "b"],
            )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "k bigint, s binary, n int, b array<bigint>")


# -- verification --------------------------------------------------------------------------


class Block:
    """Texts with their shingle sets: rep (long), copies, and the sets joined; their band hashes (a row each) and, as bits, which of these are of large
    buckets (none of either where all pairs count)."""

    def __init__(self, reps: np.ndarray, copies: np.ndarray, sizes: np.ndarray, items: np.ndarray, bands: np.ndarray, heavy: np.ndarray):
        self.reps, self.copies, self.sizes, self.items, self.bands, self.heavy = reps, copies, sizes, items, bands, heavy

    def packed(self) -> bytes:
        values, place = np.unique(self.items, return_inverse=True)
        head = np.array([len(self.reps), len(values), self.bands.shape[1]])
        longs = [head, self.reps, self.copies, self.sizes, self.heavy, self.bands.ravel()]
        parts = [*(x.astype("<i8") for x in longs), values.astype("<u8"), place.astype("<u4")]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, m, bands = np.frombuffer(raw, "<i8", 3).tolist()
        reps, copies, sizes, heavy = np.frombuffer(raw, "<i8", 4 * n, 24).reshape(4, n)
        at = 24 + 32 * n
        hashes = np.frombuffer(raw, "<i8", n * bands, at).reshape(n, bands)
        at += 8 * n * bands
        values = np.frombuffer(raw, "<u8", m, at)
        return cls(reps, copies, sizes, values[np.frombuffer(raw, "<u4", -1, at + 8 * m)], hashes, heavy)


def intersections(a: Block, b: Block) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b; only shingles of both sides make columns."""
    shared = np.intersect1d(np.unique(a.items), np.unique(b.items), assume_unique=True)
    if a is b:
        values, counts = np.unique(a.items, return_counts=True)
        shared = values[counts > 1]
    out = np.zeros((len(a.reps), len(b.reps)), np.float32)

    def cells(block: Block) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(block.reps)), block.sizes)
        place = np.minimum(np.searchsorted(shared, block.items), len(shared) - 1)
        hit = shared[place] == block.items
        return rows[hit], place[hit]

    if len(shared):
        sides = [cells(a)] if a is b else [cells(a), cells(b)]
        for begin in range(0, len(shared), COLUMNS):
            dense = []
            for block, (rows, place) in zip((a, b), sides, strict=False):
                own = (place >= begin) & (place < begin + COLUMNS)
                matrix = np.zeros((len(block.reps), min(COLUMNS, len(shared) - begin)), np.float32)
                matrix[rows[own], place[own] - begin] = 1
                dense.append(matrix)
            out += dense[0] @ dense[-1].T
    return out.astype(np.int64)


def counted(a: Block, b: Block, band: int | None) -> np.ndarray:
    """Pairs whose first shared band is ``band``; without one those whose first shared band is a large bucket's, or that share none."""
    first = np.full((len(a.reps), len(b.reps)), -1, np.int8)
    for k in range(a.bands.shape[1] - 1, -1, -1):
        first[a.bands[:, k, None] == b.bands[None, :, k]] = k
    if band is not None:
        return first == band
    return (first < 0) | ((a.heavy[:, None] >> np.maximum(first, 0)) & 1 == 1)


def verify(a: Block, b: Block, threshold: Fraction, every: bool = True, band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, weight of links, smallest connected rep, for the texts of a tile that have a link there. every: all pairs count, else see ``counted``."""
    p, q = threshold.numerator, threshold.denominator
    linked = intersections(a, b) * (p + q) >= p * (a.sizes[:, None] + b.sizes[None, :])
    if not every:
        linked &= counted(a, b, band)
    if a is b:
        np.fill_diagonal(linked, False)
        reps, links, square = a.reps, linked @ a.copies, linked
    else:
        n, m = linked.shape
        reps = np.concatenate([a.reps, b.reps])
        links = np.concatenate([linked @ b.copies, linked.T @ a.copies])
        square = np.zeros((n + m, n + m), bool)
        square[:n, n:], square[n:, :n] = linked, linked.T
    order = np.argsort(reps, kind="stable")
    square = square[np.ix_(order, order)]
    roots = np.empty_like(reps)
    roots[order] = reps[order][components.labels_in(square)]
    some = links > 0
    return reps[some], links[some], roots[some]


def _found(reps: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    none = len(reps)
    return pa.RecordBatch.from_arrays(
        [pa.array(reps), pa.array(links), pa.array(roots), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
        names=["rep", "links", "root", "comp", "cls", "block", "data"],
    )


_FOUND = "rep bigint, links bigint, root bigint, comp bigint, cls int, block int, data binary"


def _gather(rows: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Rows of a deal (see ``deal``) with their texts, those of a block together: blocks that are alone are verified, others packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def block() -> pa.RecordBatch:
            (_, comp, cls, number, alone, band), seen = at, {}
            sets = shingles.sets([t for *_, t in held], size)
            for (rep, copies, digest, hashes, heavy, _), items in zip(held, sets, strict=True):
                if hashlib.blake2b(items.tobytes(), digest_size=16).digest() == digest:  # else another text of the same key
                    seen.setdefault((rep, digest), (copies, items, hashes or [], heavy or 0))
            own = Block(
                np.array([r for r, _ in seen], np.int64),
                np.array([c for c, *_ in seen.values()], np.int64),
                np.array([len(i) for _, i, *_ in seen.values()], np.int64),
                np.concatenate([i for _, i, *_ in seen.values()]),
                np.array([h for *_, h, _ in seen.values()], np.int64).reshape(len(seen), -1),
                np.array([x for *_, x in seen.values()], np.int64),
            )
            if alone:
                return _found(*verify(own, own, threshold, at[0] == WHOLE, band))
            none = [pa.nulls(1, pa.int64())] * 3
            return pa.RecordBatch.from_arrays(
                [*none, pa.array([comp], pa.int64()), pa.array([cls], pa.int32()), pa.array([number], pa.int32()), pa.array([own.packed()], pa.binary())],
                names=["rep", "links", "root", "comp", "cls", "block", "data"],
            )

        for batch in common.slices(batches):
            for *place, rep, copies, digest, hashes, heavy, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if held:
                        yield block()
                    held, at = [], place
                held.append((rep, copies, digest, hashes, heavy, t))
        if held:
            yield block()

    return rows.select("kind", "comp", "cls", "block", "alone", "band", "rep", "copies", "s", "b", "heavy", "t").mapInArrow(run, _FOUND)


def _tiles(blocks: DataFrame, parts: DataFrame, threshold: Fraction) -> DataFrame:
    """All tiles of packed blocks: a block with itself, those after it in its class, and all of the next class."""
    same = parts.select("comp", "cls", F.col("blocks").alias("own"))
    after = parts.select("comp", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("next"))
    partners = F.concat(
        F.transform(F.sequence("block", F.col("own") - 1), lambda j: F.struct(F.col("cls").alias("c"), j.cast("int").alias("j"))),
        F.when(F.col("next").isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce("next", F.lit(1)) - 1), lambda j: F.struct((F.col("cls") + 1).alias("c"), j.cast("int").alias("j")))).otherwise(F.array()),
    )
    left = blocks.join(same, ["comp", "cls"]).join(after, ["comp", "cls"], "left").select("comp", "cls", "block", "data", F.explode(partners).alias("p"))
    left = left.select("comp", "cls", "block", "data", F.col("p.c").alias("c"), F.col("p.j").alias("j"))
    right = blocks.select("comp", F.col("cls").alias("c"), F.col("block").alias("j"), F.col("data").alias("other"))
    pairs = left.join(right, ["comp", "c", "j"]).select("data", F.when((F.col("cls") == F.col("c")) & (F.col("block") == F.col("j")), F.lit(None).cast("binary")).otherwise(F.col("other")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, other in zip(batch.column(0), batch.column(1), strict=True):
                a = Block.unpacked(mine.as_py())
                b = Block.unpacked(other.as_py()) if other.is_valid else a
                yield _found(*verify(a, b, threshold, every=False))

    return pairs.mapInArrow(run, _FOUND)


# -- the join ------------------------------------------------------------------------------

#: Kinds of blocks: a component, a bucket, a part of a component of large buckets.
WHOLE, BUCKET, PART = range(3)


def _fits(total: str = "total", count: str = "count") -> Column:
    return (F.col(total) <= BLOCK_SHINGLES) & (F.col(count) <= BLOCK_TEXTS)


def deal(members: DataFrame, rows: DataFrame, threshold: Fraction, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Into which blocks texts go: ``kind``, ``comp``, ``cls``, ``block``, ``alone`` (no tile beside its own), ``band``, and of each text ``rep``, ``copies``, ``s``, ``b``,
    ``heavy``; and the numbers of ``blocks`` of each ``comp`` and ``cls`` of the last kind.

    members: ``rep``, ``s``, ``copies``, ``n``, ``comp`` of the texts that share a bucket; rows: ``k``, ``s``, ``b`` of all.
    """
    size = [F.sum("n").alias("total"), F.count("*").alias("count")]
    whole = common.durable(members.groupBy("comp").agg(*size).select("comp", _fits().alias("alone")), "whole", scratch)
    none = {"int": F.lit(None).cast("int"), "bands": F.lit(None).cast("array<bigint>"), "bigint": F.lit(None).cast("bigint")}
    small = members.join(whole.where("alone").select("comp"), "comp").select(
        F.lit(WHOLE).alias("kind"), "comp", F.lit(0).alias("cls"), F.lit(0).alias("block"), F.lit(True).alias("alone"), none["int"].alias("band"), "rep", "copies", "s", none["bands"].alias("b"), none["bigint"].alias("heavy"),
    )
    no_parts = whole.limit(0).select("comp", F.lit(0).alias("cls"), F.lit(0).alias("blocks"))
    large = whole.where("not alone").select("comp")
    if large.isEmpty():
        return small, no_parts
    large = members.join(large, "comp").select("rep", "s", "copies", "n")
    large = common.durable(large.join(rows.select(F.col("k").alias("rep"), "s", "b"), ["rep", "s"]).distinct(), "large", scratch)
    placed = large.select("rep", "n", F.posexplode("b").alias("band", "h"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"x{k}") for k in range(2)]
    buckets = common.durable(placed.groupBy("h", "band").agg(*size, F.min("rep").alias("hub"), *marks).where("count > 1"), "buckets", scratch)
    light = (F.col("count") <= LIGHT) & (F.col("total") <= BLOCK_SHINGLES)
    # Of buckets with the same members the first is enough.
    kept = buckets.where(light).groupBy("x0", "x1", "count").agg(F.min(F.struct("band", "h")).alias("first")).select("first.*")
    heavy = placed.join(buckets.where(~light).select("h", "band", "hub"), ["h", "band"]).select("rep", "band", "hub")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("band"))
    bits = common.durable(heavy.groupBy("rep").agg(F.bit_or(bit).alias("heavy")), "heavy", scratch)
    own = large.join(bits, "rep", "left").select("rep", "s", "copies", "n", "b", F.coalesce("heavy", F.lit(0).cast("bigint")).alias("heavy"))
    of_buckets = placed.select("rep", "h", "band").join(kept, ["h", "band"]).join(own, "rep").select(
        F.lit(BUCKET).alias("kind"), F.col("h").alias("comp"), F.lit(0).alias("cls"), F.lit(0).alias("block"), F.lit(True).alias("alone"), "band", "rep", "copies", "s", "b", "heavy",
    )
    # Components of the large buckets alone, dealt by size and hash.
    near = components.components(heavy.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    sized = own.join(near, "rep").withColumn("cls", F.floor(F.log("n") / math.log(float(1 / threshold)) + 1e-9).cast("int"))
    sized = common.durable(sized, "sized", scratch)
    fits = sized.groupBy("comp").agg(*size).select("comp", _fits().alias("alone"))
    parts = sized.groupBy("comp", "cls").agg(*size).select("comp", "cls", F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("count") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    parts = common.durable(parts, "blocks", scratch)
    of_parts = sized.join(fits, "comp").join(parts, ["comp", "cls"]).select(
        F.lit(PART).alias("kind"), "comp", F.when(F.col("alone"), 0).otherwise(F.col("cls")).alias("cls"), F.when(F.col("alone"), 0).otherwise(F.pmod(F.xxhash64("rep", "s"), F.col("blocks"))).cast("int").alias("block"),
        "alone", none["int"].alias("band"), "rep", "copies", "s", "b", "heavy",
    )
    return small.unionByName(of_buckets).unionByName(of_parts), parts


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``key``, ``class_id`` (smallest key of its class), ``n_links``, ``copies`` (documents with the same shingle set) of every key."""
    scratch: list[str] = []
    rows, texts, members = candidates(docs, key, text, size, threshold, recall, scratch)
    dealt, parts = deal(members, rows, threshold, scratch)
    own_text = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("t"))
    # Always by a shuffle: the members grow with the texts.
    placed = own_text.join(dealt.hint("merge"), "rep").repartition("kind", "comp", "cls", "block").sortWithinPartitions("kind", "comp", "cls", "block", "rep", "s")
    first = common.durable(_gather(placed, size, threshold), "verified")
    links = first.where("rep is not null").select("rep", "links", "root")
    blocks = first.where("data is not null").select("comp", "cls", "block", "data")
    if not blocks.isEmpty():
        more = common.durable(_tiles(blocks, parts, threshold), "verified")
        links = links.union(more.select("rep", "links", "root"))
    common.remove(docs.sparkSession, scratch)
    classes = components.components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("rep"), F.col("b").alias("class_id"))
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"))
    told = texts.join(summed, "rep", "left").join(classes, "rep", "left").select(
        "s", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("k", "s").join(told, "s").select("k", "class_id", "n_links", "copies")
    return out.groupBy(F.col("k").alias(key)).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("copies").alias("copies"))


def candidates(docs: DataFrame, key: str, text: str, size: int, threshold: Fraction, recall: float, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; ``s``, ``rep``, ``copies`` of the different texts; ``rep``, ``s``, ``copies``, ``n``, ``comp`` of those that share a bucket."""
    bands = Bands(*banding(float(threshold), recall, MOST_HASHES))
    rows = common.durable(signatures(docs, key, text, size, bands), "signatures")
    texts = common.durable(rows.groupBy("s").agg(F.min("k").alias("rep"), F.countDistinct("k").alias("copies")), "texts")
    of_reps = rows.join(texts, (rows["s"] == texts["s"]) & (rows["k"] == texts["rep"]))

    # One row for each text and band; buckets of one text are gone after the first aggregation.
    firsts = common.durable(of_reps.select("rep", F.explode("b").alias("h")).distinct(), "bands", scratch)
    hubs = firsts.groupBy("h").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").select("h", "hub")
    edges = firsts.join(hubs, "h").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    near = components.components(edges).select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    members = of_reps.select("rep", texts["s"], "copies", "n").distinct().join(near, "rep")
    return rows, texts, common.durable(members, "members", scratch)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each class, one row of it, and rows without a key. Texts that share a key are documents of their own."""
    keyed = docs.where(F.col(key).isNotNull())
    if keyed.count() > keyed.select(key).distinct().count():
        return _keep_one_text(keyed, key, text).unionByName(docs.where(F.col(key).isNull()))
    found = common.durable(join(docs, key, text), "classes")
    gone = found.where(F.col(key) != F.col("class_id")).select(F.col(key).cast(docs.schema[key].dataType).alias(key))
    return docs.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)


def _keep_one_text(keyed: DataFrame, key: str, text: str) -> DataFrame:
    """``keep_one`` where keys repeat: classes are of (key, text), each with a number of its own."""
    texts = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    texts = common.durable(texts.withColumn("id", F.monotonically_increasing_id()), "numbered")
    found = common.durable(join(texts, "id", "text"), "classes")
    first = F.min(F.struct("key", F.xxhash64("text").alias("h"), "id"))
    best = found.join(texts, "id").groupBy("class_id").agg(first.alias("first")).select("first.id")
    kept = texts.join(best, "id").select(F.col("key").alias("kept_key"), F.col("text").alias("kept_text"))
    same = (keyed[key] == kept["kept_key"]) & keyed[text].eqNullSafe(kept["kept_text"])
    return keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates([key, text])
