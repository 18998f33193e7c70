"""The inverted index as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis

#: Row numbers that are broadcast at most (8 bytes each).
MOST_BROADCAST = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer partitions than half the cores, dealt over all cores; anything else as it is.

    Analysing texts takes much longer than moving them. Large tables have more partitions and aren't moved.
    """
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df  # it has exchanges of its own
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def with_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` (rowid, fields and more) with ``doc_len``, the number of tokens of all fields."""
    return docs.withColumn("doc_len", analysis.token_count(F.col("fields")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _by_term(occurrences: Column) -> Column:
    """The (term, position) of one document as (term, tf, positions), one a term: one sort, then linear."""

    def entry(rows: Column, begin: Column, end: Column) -> Column:
        positions = F.transform(F.slice(rows, begin + 1, end - begin), lambda x: x["position"])
        return F.struct(rows[begin]["term"].alias("term"), (end - begin).alias("tf"), positions.alias("positions"))

    def grouped(rows: Column) -> Column:
        first = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (F.get(rows, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
        return _let(first, lambda begins: F.transform(begins, lambda begin, k: entry(rows, begin, F.coalesce(F.get(begins, k + 1), F.size(rows)))))

    return _let(F.sort_array(occurrences), grouped)


def build_postings(docs: DataFrame, *keep: str) -> DataFrame:
    """``term``, ``rowid``, ``tf``, ``doc_len``, ``positions`` (ascending), and the columns ``keep``, of documents (rowid, fields) whose rowids differ.

    Each document's tokens are grouped where it lies, so nothing goes through an exchange or is held but one document.
    """
    # A generator of one row keeps the tokens from being computed once for each use.
    tokens = docs.select("rowid", *keep, F.explode(F.array(analysis.occurrences(F.col("fields")))).alias("o"))
    rows = tokens.select("rowid", *keep, F.size("o").alias("doc_len"), F.explode(_by_term(F.col("o"))).alias("t"))
    return rows.select("t.term", "rowid", *keep, "t.tf", "doc_len", "t.positions")


def gather_postings(docs: DataFrame, wanted: Callable[[Column], Column] | None = None, required: Iterable[str] = ()) -> DataFrame:
    """The same of documents whose rowids may be repeated, grouped by an exchange.

    wanted: a condition on terms; other tokens are dropped before they become rows. required: terms without which a document has no rows.
    """
    tokens = docs.select("rowid", F.explode(F.array(analysis.occurrences(F.col("fields")))).alias("o"))
    for term in sorted(required):
        tokens = tokens.where(F.array_contains(F.col("o.term"), term))
    own = F.filter("o", lambda t: wanted(t["term"])) if wanted else F.col("o")
    rows = tokens.select("rowid", F.size("o").alias("doc_len"), F.explode(own).alias("t"))
    grouped = rows.select("rowid", "doc_len", "t.term", "t.position").groupBy("term", "rowid", "doc_len")
    return grouped.agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions")).select("term", "rowid", "tf", "doc_len", "positions")


@dataclass
class Index:
    """docs: rowid, fields, doc_len of live documents; postings: term, rowid, tf, doc_len, positions of the same."""

    docs: DataFrame
    #: The postings; None if they are made of the source when asked for.
    stored: DataFrame | None
    segments: int = 1
    #: The documents (rowid, fields), if postings aren't stored but made when asked for.
    source: DataFrame | None = None
    #: Live documents and tokens of all of them, where they were counted before.
    known: tuple[int, int] | None = None

    @classmethod
    def of(cls, docs: DataFrame, rowid: str = "rowid", fields: list[str] | None = None) -> Index:
        """Index a DataFrame in place. ``fields``: string columns; else ``fields`` is an array column."""
        own = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in fields]) if fields else F.col("fields")
        rows = spread(docs.select(F.col(rowid).cast("bigint").alias("rowid"), own.alias("fields")))
        return cls(with_lengths(rows), None, source=rows)

    @cached_property
    def postings(self) -> DataFrame:
        """All postings. If they aren't stored, rowids are looked at first: documents go through an exchange only if some are repeated."""
        if self.stored is not None:
            return self.stored
        repeated = self.source.groupBy("rowid").agg(F.count("*").alias("n")).where("n > 1")
        return build_postings(self.source) if repeated.isEmpty() else gather_postings(self.source)

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Live documents, and tokens of all of them."""
        if self.known is None:
            row = self.docs.agg(F.count("*").alias("n"), F.sum("doc_len").alias("t")).first()
            return row.n, row.t or 0
        return self.known

    def frequencies(self, terms: set[str]) -> dict[str, int]:
        """In how many live documents each of some terms stands: one row a term. An index that isn't stored is counted as a whole in the same pass."""
        order = sorted(terms)
        if self.source is None:
            found = self.postings.where(F.col("term").isin(order)).groupBy("term").agg(F.count("*").alias("n")).collect() if order else []
            return dict.fromkeys(order, 0) | {r.term: r.n for r in found}
        tokens = self.source.select(F.explode(F.array(F.transform(analysis.occurrences(F.col("fields")), lambda t: t["term"]))).alias("o"))
        counts = [F.count_if(F.array_contains("o", t)).alias(f"t{k}") for k, t in enumerate(order)]
        row = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("o")), F.lit(0)).alias("t"), *counts).first()
        self.known = (row.n, row.t)
        return {t: row[f"t{k}"] for k, t in enumerate(order)}

    def needed(self, terms: set[str], prefixes: set[str], required: dict[str, int] | None = None) -> DataFrame:
        """The postings of some terms and of all terms with some prefixes; of a stored index both reach the scan as pushed filters.

        required: terms (with their frequencies) without which documents aren't asked for; theirs are dropped before any exchange.
        """
        if self.source is not None:
            return gather_postings(self.source, wanted=lambda term: matches_leaf(terms, prefixes, term), required=required or ())
        rows = self.postings.where(matches_leaf(terms, prefixes))
        if not required or len(terms) + len(prefixes) == 1:
            return rows
        rare = min(required, key=lambda t: (required[t], t))
        if required[rare] > MOST_BROADCAST:
            return rows
        few = F.broadcast(self.postings.where(F.col("term") == rare).select("rowid"))
        return rows.join(few, "rowid", "left_semi").select(*self.postings.columns)


def matches_leaf(terms: set[str], prefixes: set[str], term: Column | None = None) -> Column:
    term = F.col("term") if term is None else term
    wanted = term.isin(sorted(terms)) if terms else F.lit(False)
    for p in sorted(prefixes):
        wanted = wanted | term.startswith(p)
    return wanted
