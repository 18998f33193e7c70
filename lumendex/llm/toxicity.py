"""Toxicity by a counterfactual-regularised classifier (operator 4).

Features are the distinct words of a text and the beginnings of its longer words (``PREFIXES``), as 64-bit hashes.
The features that tell the classes apart in a bounded sample of labelled rows (``SAMPLE`` of each class at most, chosen by
hash of the key, so any labelled row may be in it) go into a logistic regression. In its loss, labelled
texts that name a group of people are paired with the same text naming another group; the squared change of
the logit is penalised, so that the mention of a group doesn't raise the score by itself. Where no labelled text names a group of
``IDENTITIES`` there are no pairs and the penalty is 0.

What leaves the executors for training is bounded: at most FEATURES features, and for each of at most 2 * SAMPLE texts those it has.
Scoring reads whole texts, however long, row by row, with the weights broadcast. Labels, language, source and key never enter a
score; other columns, whatever their names, aren't read. Null texts count as empty; an empty text's score is the model's prior. A key with several labels is
toxic if any is; null labels are none. Features are chosen by all texts of a sampled key, and one of them is learned from (that of the least hash); repeated rows get the same score each. Without
labels, or labelled texts, of both classes the score is the share of toxic labels (0 without labels). Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, scan, shingles

#: Rows of each class in the sample, features of the model, word beginnings in characters, rows and strength that a feature needs.
SAMPLE, FEATURES, PREFIXES, LEAST_ROWS, LEAST_Z = 6000, 4096, (3, 4, 5, 6, 8), 2, 3.0
#: Weights of the counterfactual penalty and of the squared weights, steps of training. Chosen, as the above, by cross-validation within training rows.
PENALTY, RIDGE, STEPS = 1.0, 1e-3, 400
CHUNK = 500_000

#: Terms for groups of people; a term is swapped for the next of its row.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "locals"), ("old", "young"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("étrangers", "français"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)
_SWAP = {w: row[(k + 1) % len(row)] for row in IDENTITIES for k, w in enumerate(row)}
_WORD = re.compile(r"\w+")


def _hashes(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the code point where each word starts."""
    points = scan.code_points(joined)
    letters = scan.class_table()[points] == scan.LETTER
    edges = np.diff(letters.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans = shingles.Spans(points)
    hashes, at = [spans.hashes(starts, ends)], [starts]
    for n in PREFIXES:
        longer = starts[ends - starts > n]
        hashes.append(shingles.mixed(spans.hashes(longer, longer + n), n))
        at.append(longer)
    return np.concatenate(hashes), np.concatenate(at)


def features(texts: list[str | None], keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, hash) pairs of whole texts, a number of rows at a time.

    ``keep``: sorted hashes; others are dropped. A longer text than CHUNK is cut at white space.
    """
    shown = None
    if keep is not None:
        shown = np.zeros(1 << 20, bool)
        shown[(keep >> np.uint64(44)).astype(np.int64)] = True

    def found(parts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) + 1 for p in parts])
        hashes, at = _hashes("\n".join(parts))
        if keep is not None and shown is not None:
            near = shown.take((hashes >> np.uint64(44)).astype(np.int64))
            hashes, at = hashes[near], at[near]
            place = np.minimum(np.searchsorted(keep, hashes), max(len(keep) - 1, 0))
            near = keep[place] == hashes if len(keep) else np.zeros(len(hashes), bool)
            hashes, at = hashes[near], at[near]
        return np.array(owners)[np.searchsorted(ends, at, "right")], hashes

    def distinct(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        rows, hashes = np.concatenate([r for r, _ in some]), np.concatenate([h for _, h in some])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        return rows[first], hashes[first]

    parts: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        low = (text or "").lower()
        if size + len(low) > CHUNK and parts:
            yield distinct([found(parts, owners)])
            parts, owners, size = [], [], 0
        if len(low) > CHUNK:
            some, begin = [], 0
            while begin < len(low):
                end = min(begin + CHUNK, len(low))
                while end < len(low) and not low[end].isspace():
                    end += 1
                some.append(found([low[begin:end]], [k]))
                begin = end
            yield distinct(some)
        else:
            parts.append(low)
            owners.append(k)
            size += len(low)
    if parts:
        yield distinct([found(parts, owners)])


def swapped(text: str) -> str | None:
    """The text with each term for a group of people swapped for another group's; None if there is none."""
    out = _WORD.sub(lambda m: _SWAP.get(m[0].lower(), m[0]), text)
    return out if out != text else None


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -np.inf

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.hashes):
            for rows, hashes in features(texts, self.hashes):
                out += np.bincount(rows, self.weights[np.searchsorted(self.hashes, hashes)], len(texts))
        return out


def fit(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[int, list[int]]], width: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: features of each text; pairs: a text and the features of its swapped version."""

    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64)

    at, cols = sparse(rows)
    pair_of = np.array([k for k, _ in pairs], np.int64)
    swap_at, swap_cols = sparse([x for _, x in pairs])
    own_at, own_cols = sparse([rows[k] for k, _ in pairs])
    n, w, b = len(rows), np.zeros(width), 0.0
    balance = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[cols], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance
        g = np.bincount(cols, error[at], width) + RIDGE * w
        if len(pair_of):
            change = (np.bincount(own_at, w[own_cols], len(pairs)) - np.bincount(swap_at, w[swap_cols], len(pairs))) * (2 * penalty / len(pairs))
            g += np.bincount(own_cols, change[own_at], width) - np.bincount(swap_cols, change[swap_at], width)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (vb**0.5 + 1e-9)
    return w, float(b)


def sample_texts(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """``k``, ``t``, ``y`` of all rows of a sample of the labelled keys (``k``, ``y``): at most SAMPLE keys of each class."""
    sample = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
        sample = some if sample is None else sample.unionByName(some)
    # At most 2 * SAMPLE keys are broadcast.
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from ``labels`` (key, label), whose rows may hold any label; those given are used."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(bias=np.inf if totals.get(1) else -np.inf)
    texts = sample_texts(docs, known, key, text)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for rows, hashes in features(batch.column(0).to_pylist()):
                values, place = np.unique(hashes, return_inverse=True)
                toxic = np.bincount(place, y[rows], len(values)).astype(np.int64)
                every = np.bincount(place, minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(every), pa.array(toxic)], names=["h", "n", "p"])

    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(bias=float(np.log(totals[1] / totals[0])))
    summed = texts.select("t", "y").mapInArrow(tally, "h bigint, n bigint, p bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    share = pos / max(pos + neg, 1)

    def surprise(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    # The root of the likelihood ratio of the feature's rows against the classes' shares.
    ratio = 2 * (surprise(F.col("p"), F.col("n") * share) + surprise(F.col("n") - F.col("p"), F.col("n") * (1 - share)))
    z = F.sqrt(F.greatest(ratio, F.lit(0.0)))
    chosen = summed.where(F.col("n") >= LEAST_ROWS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(FEATURES).collect()
    hashes = np.sort(np.array([r.h for r in chosen], np.int64).view(np.uint64))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(some: list[str | None]) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in some]
            for rows, found in features(some, hashes):
                for r, f in zip(rows.tolist(), np.searchsorted(hashes, found).tolist(), strict=True):
                    out[r].append(f)
            return out

        for batch in common.slices(batches):
            some = [t or "" for t in batch.column(0).to_pylist()]
            other = [swapped(t) for t in some]
            own, changed = lists(some), lists(other)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(own, pa.list_(pa.int32())), pa.array([None if o is None else c for o, c in zip(other, changed, strict=True)], pa.list_(pa.int32()))],
                names=["k", "h", "y", "own", "other"],
            )

    kind = texts.schema["k"].dataType.simpleString()
    rows = texts.select("t", "k", F.xxhash64("t").alias("h"), "y").mapInArrow(present, f"k {kind}, h bigint, y int, own array<int>, other array<int>")
    one = rows.groupBy("k").agg(F.min(F.struct("h", "y", "own", "other")).alias("r")).select("r.*")
    got = one.collect()  # at most 2 * SAMPLE rows of at most FEATURES numbers each
    got.sort(key=lambda r: (r.y, r.own, r.other or []))  # the order of arrival must not matter
    pairs = [(k, list(r.other)) for k, r in enumerate(got) if r.other is not None]
    own = [list(r.own) for r in got]
    y = np.array([r.y for r in got], float)
    w, _ = fit(own, y, pairs, len(hashes))
    sums = np.array([w[x].sum() for x in own])
    # Classes weigh the same in training; the border is set for their true shares.
    return Model(hashes, w, -best_border(sums, y, np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))))


def best_border(sums: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Where to cut so that the least weight is on the wrong side; in the middle of the gap there, of equals the widest gap."""
    order = np.argsort(sums, kind="stable")
    z, y, v = sums[order], labels[order], weights[order]
    # Wrong when the k lowest are called 0.
    wrong = np.concatenate([[0.0], np.cumsum(v * (y == 1))]) + np.concatenate([np.cumsum((v * (y == 0))[::-1])[::-1], [0.0]])
    low, high = np.concatenate([[z[0] - 2], z]), np.concatenate([z, [z[-1] + 2]])
    wrong[high - low <= 1e-9] = np.inf  # no cut between equal sums
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[np.argmax((high - low)[best])]
    return float((low[k] + high[k]) / 2)


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """The score (0 to 1) of each text, by the broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        parts = [shared.value.logits(column.slice(k, 500).to_pylist()) for k in range(0, len(column), 500)]
        z = np.concatenate(parts) if parts else np.empty(0)
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-z)))

    return run(text)


def held_out(key: Column) -> Column:
    """One row in five, by checksum of the key as text; those without a key aren't."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` of all rows; labels of held-out keys aren't read."""
    model = train(docs, labels.where(~held_out(F.col(key))), key, text)
    rows = docs.select(F.col(key), F.col(text).alias("t"))
    out = rows.select(key, held_out(F.col(key)).alias("held_out"), score(F.col("t"), model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns."""
    model = train(docs, labels.where(~held_out(F.col(key))), key, text)
    return docs.where(score(F.col(text), model, docs) < 0.5)
