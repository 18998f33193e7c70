"""BM25 as column arithmetic, in single precision (the engine's) or double (for comparisons in SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Bm25:
    def __init__(self, k1: float, b: float, live_docs: int, total_len: int, precision: str = "float"):
        self.kind = precision
        self.k1, self.b = self._lit(k1), self._lit(b)
        self.docs = self._lit(float(live_docs))
        average = self._lit(float(total_len)) / self.docs if live_docs else self._lit(1.0)
        self.average = F.greatest(average.cast(self.kind), self._lit(1.0))

    def _lit(self, x: float) -> Column:
        return F.lit(float(x)).cast(self.kind)

    def idf(self, df: Column) -> Column:
        df = df.cast(self.kind)
        ratio = ((self.docs - df + self._lit(0.5)) / (df + self._lit(0.5))).cast(self.kind)
        return F.log(ratio + self._lit(1.0)).cast(self.kind)

    def budget(self, doc_len: Column) -> Column:
        """The part of a document's score that only its length decides."""
        share = (self.b * doc_len.cast(self.kind) / self.average).cast(self.kind)
        return self.k1 * (self._lit(1.0) - self.b + share)

    def score(self, idf: Column, tf: Column, doc_len: Column) -> Column:
        tf = tf.cast(self.kind)
        return (idf * (tf * (self.k1 + self._lit(1.0))) / (tf + self.budget(doc_len))).cast(self.kind)

    def total(self, parts: Column) -> Column:
        """The sum of (term, s) in the order of terms, in this precision."""
        return F.aggregate(F.array_sort(parts), self._lit(0.0), lambda acc, x: acc + x["s"])


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
