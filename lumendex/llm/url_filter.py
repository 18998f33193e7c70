"""URL filter by a character language-model ratio (operator 1).

Rules judge the URLs that they fit. The other URLs are judged by two smoothed variable-order
Markov models of characters, one of the URLs that rules allow, one of those they block: each
order's estimate is blended with the next shorter context's. The score is the log-likelihood difference
divided by the length. Models count four fifths of the ruled URLs (all of them, chosen by hash); the
last fifth calibrates the threshold: the one with the best mean of both classes' accuracies.

Counts are of exact byte n-grams, in a table that grows with the URLs: summed in tasks, then by n-gram. A place's estimates
depend on the ORDER bytes that end there, so they are joined order by order to the distinct n-grams; URLs are scored in blocks
of ``2**BLOCK_BITS`` rows, each of which asks once for each of its n-grams. The driver gets only the bins of calibration.

Null URLs and those without ``://`` have an empty host and path and fit no rule; a null or empty URL has score 0.
Without ruled URLs of both kinds the threshold is 0. Repeated URLs count each. Long URLs are read whole. Empty tables give no rows. Other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

#: Longest n-gram, rows of a block, weight of the shorter context's estimate, bins of calibration.
ORDER, BLOCK_BITS, WEIGHT, BINS, RANGE = 5, 12, 4.0, 4096, 8.0
_START, _STOP = 0x02, 0x03


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(host, upper, upper.lower()), path


def ruling(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ORDER bytes that ends at each byte of each URL (and at its end), as a number whose lowest byte is
    the last, and the row of each place. Shorter n-grams are its lower bytes."""
    raw = [(u or "").encode() for u in urls]
    pad = bytes([_START]) * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + r + bytes([_STOP]) for r in raw), np.uint8).astype(np.int64)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.repeat(begins, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    packed = np.zeros(len(at), np.int64)
    for n in range(ORDER):
        packed |= data[at - n] << (8 * n)
    return packed, np.repeat(np.arange(len(raw)), sizes)


def count_grams(ruled: DataFrame) -> DataFrame:
    """``gram``, ``allow``, ``block``: how often each n-gram of ORDER bytes stands in the rows' ``url``s of either ``verdict``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2000):
            grams, rows = _grams(batch.column(0).to_pylist())
            blocked = np.array([v == "block" for v in batch.column(1).to_pylist()], bool)[rows]
            found, which = np.unique(grams, return_inverse=True)
            both = np.bincount(which, minlength=len(found))
            block = np.bincount(which[blocked], minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(both - block), pa.array(block)], names=["gram", "allow", "block"])

    some = ruled.select("url", "verdict").mapInArrow(run, "gram bigint, allow bigint, block bigint")
    return some.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def _suffix(gram: Column, n: Column | int) -> Column:
    return gram.bitwiseAND(F.expr(f"{(1 << 8 * n) - 1}L") if isinstance(n, int) else F.element_at(F.array(*(F.expr(f"{(1 << 8 * k) - 1}L") for k in range(1, ORDER + 1))), n))


def ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram``, ``ratio``: the log of the models' probabilities' ratio at the last byte of each ``gram`` of ``wanted`` and ``counts``.

    Order by order, an n-gram's estimate takes that of its suffix: a join in which at most 256 rows share a key.
    """
    zero = F.lit(0).cast("bigint")
    every = counts.unionByName(wanted.select("gram", zero.alias("allow"), zero.alias("block")))
    orders = every.select(F.explode(F.array(*map(F.lit, range(1, ORDER + 1)))).alias("n"), "*")
    orders = orders.select("n", _suffix(F.col("gram"), F.col("n")).alias("gram"), "allow", "block").groupBy("n", "gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    context = Window.partitionBy("n", F.shiftright("gram", 8))
    sums = [F.sum(m).over(context).alias(f"{m}_context") for m in ("allow", "block")]
    orders = common.durable(orders.select("*", *sums), "grams")

    def blended(m: str, shorter: Column) -> Column:
        return ((F.col(m) + WEIGHT * shorter) / (F.col(f"{m}_context") + WEIGHT)).alias(m)

    level = orders.where(F.col("n") == 1).select("gram", *(blended(m, F.lit(1 / 256)) for m in ("allow", "block")))
    for n in range(2, ORDER + 1):
        shorter = level.select(F.col("gram").alias("suffix"), F.col("allow").alias("p"), F.col("block").alias("q"))
        longer = orders.where(F.col("n") == n).withColumn("suffix", _suffix(F.col("gram"), n - 1))
        level = longer.join(shorter, "suffix").select("gram", blended("allow", F.col("p")), blended("block", F.col("q")))
    return level.select("gram", (F.log("allow") - F.log("block")).alias("ratio"))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``score``: the length-normalised log-likelihood difference of their ``url``s, above 0 if the model of allowed
    URLs fits better. ``rows`` has a column ``block`` with few enough rows of a value for one task; a block asks for each n-gram once."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = _grams(batch.column(1).to_pylist())
            blocks, own = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            found = np.unique((own[at] << 8 * ORDER) | grams)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[found >> 8 * ORDER]), pa.array(found & ((1 << 8 * ORDER) - 1))], names=["block", "gram"])

    def answered(urls: pa.Table, found: pa.Table) -> pa.Table:
        grams, ratio = (found.column(c).to_numpy() for c in ("gram", "ratio"))
        order = np.argsort(grams)
        grams, ratio = grams[order], ratio[order]
        texts, out = urls.column("url").to_pylist(), []
        for begin in range(0, len(texts), 2000):
            some = texts[begin : begin + 2000]
            own, at = _grams(some)
            means = np.bincount(at, ratio[np.searchsorted(grams, own)], len(some)) / np.bincount(at, minlength=len(some))
            out.append(np.where([bool(u) for u in some], means, 0.0))
        return urls.append_column("score", pa.array(np.concatenate(out) if out else np.empty(0)))

    wanted = common.durable(rows.select("block", "url").mapInArrow(asked, "block bigint, gram bigint"), "asked")
    answers = wanted.join(ratios(counts, wanted.select("gram").distinct()), "gram").select("block", "gram", "ratio")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered, schema)


def score(urls: list[str | None], counts: DataFrame) -> np.ndarray:
    """``scored`` for a list."""
    rows = counts.sparkSession.createDataFrame([(0, i, u) for i, u in enumerate(urls)], "block long, i long, url string")
    return np.array([r.score for r in sorted(scored(rows, counts).collect(), key=lambda r: r.i)])


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` of every row."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = ruling(rules, F.col("host"), F.col("path"))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    ruled = common.durable(parts.select("*", text.alias("rule"), verdict.alias("verdict"), block.alias("block")), "ruled")
    part = F.pmod(F.xxhash64("url"), F.lit(5))
    out = common.durable(scored(ruled, count_grams(ruled.where(F.col("verdict").isNotNull() & (part != 0)))), "scored")
    held = out.where(F.col("verdict").isNotNull() & (part == 0))
    cell = F.floor((F.greatest(F.least(F.col("score"), F.lit(RANGE)), F.lit(-RANGE)) + RANGE) / (2 * RANGE) * BINS).cast("int")
    bins = held.groupBy(cell.alias("cell"), "verdict").count().collect()  # at most 2 * (BINS + 1) rows
    threshold = best_threshold([(r.cell, r.verdict, r["count"]) for r in bins])
    own = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def best_threshold(bins: list[tuple[int, str, int]]) -> float:
    """The lower edge of the bin from which on allowing gives the best mean accuracy; of equals the nearest to 0."""
    tally = np.zeros((2, BINS + 1), np.int64)
    for cell, verdict, n in bins:
        tally[int(verdict == "block"), cell] += n
    if not tally.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(tally, axis=1)[:, :-1]], axis=1)
    mean = (1 - below[0] / tally[0].sum()) + below[1] / tally[1].sum()
    edges = np.arange(BINS + 1) / BINS * 2 * RANGE - RANGE
    tied = np.flatnonzero(mean >= mean.max() - 1e-12)
    return float(edges[tied[np.argmin(np.abs(edges[tied]))]])
