"""A stream of documents into a store: each micro-batch is one commit, and is committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import MOST_BROADCAST
from ..sources.store import Database


def _one_each(rows: DataFrame) -> DataFrame:
    """``rowid``, ``r``: of rows with equal ids that with the greatest ``at`` (if none has any, one of them). Only ids, and rows whose id is repeated, go through an exchange."""
    repeated = rows.groupBy("rowid").agg(F.count("*").alias("n")).where("n > 1").select("rowid")
    count = repeated.count()
    if not count:
        return rows.select("rowid", "r")
    pick = lambda some: some.groupBy("rowid").agg(F.coalesce(F.max_by("r", "at"), F.first("r")).alias("r"))
    if count > MOST_BROADCAST:
        return pick(rows)
    few = F.broadcast(repeated)
    return rows.join(few, "rowid", "left_anti").select("rowid", "r").unionByName(pick(rows.join(few, "rowid", "left_semi")))


def ingest_stream(database: Database, stream: DataFrame, rowid: str, fields: list[str], name: str, checkpoint: str, order_by: str | None = None, **trigger) -> StreamingQuery:
    """Start the query. ``name`` identifies the stream in the store, so a batch that is run again changes nothing.

    Of rows with equal ids in a batch the last by ``order_by`` (or any, without it) counts.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if database.has_batch(name, number):
            return
        row = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])
        rows = batch.where(F.col(rowid).isNotNull()).withColumns({"rowid": F.col(rowid).cast("bigint"), "r": row, "at": F.col(order_by) if order_by else F.lit(0)}).select("rowid", "r", "at")
        database.upsert_df(_one_each(rows).select("rowid", F.array(*[F.col(f"r.f{k}") for k in range(len(fields))]).alias("fields")), "rowid", "fields", (name, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
