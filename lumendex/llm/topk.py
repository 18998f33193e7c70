"""Exact top-k search by inner product (operator 3).

Vectors and queries are packed into blocks where they lie, without an exchange. Each tile (a
block of queries against a block of vectors) is one matrix product of whole numbers, from
which the best k of each query are selected. A query's lists, one for each block of vectors, are merged as a tree: about ``FAN_IN`` lists at a time, with as
many levels as their number asks for. A product is computed in doubles if all
its sums are below 2**53, else in 64-bit integers, else in Python's, so scores are exact; a score beyond 64 bits is given, and ranked, as the nearest number that fits.

Null vectors, and those with null or non-finite components, take no part, nor do null ids. Vectors are
compared with those of their own length only (of any length, none included). Ties go to the smaller id. Rows
with the query's own id are no candidates; other repeated rows count each, and of repeated query rows each gets its own list. Too few candidates give all of
them, empty tables none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS, FAN_IN = 4096, 512, 16
_KINDS = ("<i1", "<i2", "<i4", "<i8")


def usable(vector: str) -> Column:
    """True for vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantised(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def largest(values: np.ndarray) -> int:
    """The largest absolute value (that of the least 64-bit number, too)."""
    return max(-int(values.min()), int(values.max())) if values.size else 0


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of id, v packed into blocks of up to ``size`` rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            values = np.concatenate(parts)
            top = largest(values)
            kind = next(k for k in _KINDS if top <= np.iinfo(k).max)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([kind]), pa.array([values.astype(kind).tobytes()])],
                names=["dim", "ids", "kind", "data"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, begin = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), size):
                    some = own[at : at + size]
                    mine = held.setdefault(dim, ([], []))
                    mine[0].append(ids[some])
                    mine[1].append(flat[(begin[some][:, None] + np.arange(dim)).ravel()])
                    if sum(map(len, mine[0])) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    out = rows.select("id", "v").mapInArrow(run, "dim int, ids binary, kind string, data binary")
    return out.select(*[F.col(c).alias(f"{prefix}_{c}") for c in out.columns], F.monotonically_increasing_id().alias(f"{prefix}_block"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, ties to the smaller id; masked scores are the least int64."""
    n = scores.shape[1]
    least = np.iinfo(np.int64).min
    if n > k:
        bound = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, columns = np.nonzero((scores >= bound[:, None]) & (scores > least))
    else:
        rows, columns = np.nonzero(scores > least)
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[rank < k], columns[rank < k]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, clamped to the numbers above the least 64-bit one, which masks."""
    bound = largest(queries) * largest(vectors) * max(1, queries.shape[1])
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = queries.astype(object) @ vectors.astype(object).T
    most = np.iinfo(np.int64).max
    return np.clip(exact, -most, most).astype(np.int64)


def tile(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries, vector ids and scores of one tile's selection."""
    scores = products(queries, vectors)
    scores[q_ids[:, None] == v_ids[None, :]] = np.iinfo(np.int64).min
    rows, columns = best(scores, v_ids, k)
    return rows, v_ids[columns], scores[rows, columns]


def _tiles(pairs: DataFrame, k: int) -> DataFrame:
    def matrix(dim: int, kind: str, data: bytes) -> np.ndarray:
        values = np.frombuffer(data, kind)
        return values.reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                q_ids, v_ids = np.frombuffer(x["q_ids"], "<i8"), np.frombuffer(x["v_ids"], "<i8")
                q, v = (matrix(x[f"{s}_dim"], x[f"{s}_kind"], x[f"{s}_data"]) for s in "qv")
                if not x["q_dim"]:
                    q, v = np.zeros((len(q_ids), 0), np.int64), np.zeros((len(v_ids), 0), np.int64)
                rows, b, s = tile(q, q_ids, v, v_ids, k)
                of_block = [pa.array(np.full(len(rows), x[c])) for c in ("q_block", "v_block")]
                yield pa.RecordBatch.from_arrays([of_block[0], pa.array(rows), pa.array(q_ids[rows]), pa.array(b), pa.array(s), of_block[1]], names=["q_block", "q_row", "query_id", "vec_id", "score", "part"])

    return pairs.mapInArrow(run, "q_block bigint, q_row bigint, query_id bigint, vec_id bigint, score bigint, part bigint")


def levels(lists: int) -> list[int]:
    """Into how many groups a query's lists are dealt, level by level, before the last merge of all that are left."""
    out, groups = [], -(-lists // FAN_IN)
    while groups > 1:
        out.append(groups)
        groups = -(-groups // FAN_IN)
    return out


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best vectors.

    Both tables have ``id`` (bigint) and ``v`` (array of bigint without nulls).
    """
    shards = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(vectors, BLOCK_ROWS, "v").withColumn("shard", F.pmod(F.xxhash64("v_block"), F.lit(shards)).cast("int"))
    # The stated queries, in blocks, go to every shard; vectors are moved once, and a tile is computed where its blocks meet.
    asked = _packed(queries, QUERY_ROWS, "q").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = _tiles(asked.join(blocks, "shard").where("q_dim = v_dim").drop("shard"), k)
    # A block for every BLOCK_ROWS rows, and a smaller one for each task and length of vectors at most.
    lists = vectors.count() // BLOCK_ROWS + vectors.rdd.getNumPartitions()
    by_rank = [F.desc("score"), F.asc("vec_id")]
    query = ["q_block", "q_row", "query_id"]
    for groups in levels(lists):
        found = found.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)))
        best_of = F.row_number().over(Window.partitionBy(*query, "g").orderBy(*by_rank))
        found = found.withColumn("r", best_of).where(F.col("r") <= k).drop("r").withColumn("part", F.col("g")).drop("g")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(*by_rank)).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
