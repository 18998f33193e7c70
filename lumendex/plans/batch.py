"""Many queries in one job.

Queries that are a term, or some terms of which one or all must be there, become rows of (query, term): these are joined to the postings, so a thousand of them cost
what their postings cost. Other trees are compiled to columns, up to ``TOGETHER`` of them over one pivot of their leaves' postings.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25, any_of
from ..operators.index import Index
from ..operators.matching import compile_query
from ..operators.query import And, Leaves, Or, Query, SearchOptions, Term, leaves
from . import search as planner

#: Trees that are compiled over one pivot.
TOGETHER = 64


def flat(query: Query) -> tuple[set[str], int] | None:
    """The terms of a query that is nothing but terms, and how many of them a document must have."""
    if isinstance(query, Term):
        return {query.text}, 1
    if isinstance(query, (And, Or)) and query.children and all(isinstance(c, Term) for c in query.children):
        terms = {c.text for c in query.children}
        return terms, len(terms) if isinstance(query, And) else 1
    return None


def _flat_hits(index: Index, queries: Mapping[int, tuple[set[str], int]], scorer: Bm25, digits: int | None) -> DataFrame:
    wanted = [(k, t, n) for k, (terms, n) in queries.items() for t in sorted(terms)]
    asked = index.docs.sparkSession.createDataFrame(wanted, "query_id bigint, term string, least int")
    needed = index.needed({t for _, t, _ in wanted}, set()).select("term", "rowid", "tf", "doc_len")
    # As many rows as the queries have terms.
    frequencies = needed.groupBy("term").agg(F.count("*").alias("df"))
    rows = needed.join(F.broadcast(asked.join(F.broadcast(frequencies), "term")), "term")
    part = F.struct("term", scorer.score(scorer.idf(F.col("df")), F.col("tf"), F.col("doc_len")).alias("s"))
    found = rows.groupBy("query_id", "rowid", "least").agg(F.collect_list(part).alias("parts")).where(F.size("parts") >= F.col("least"))
    total = scorer.total(F.col("parts"))
    return found.select("query_id", "rowid", (F.round(total, digits) if digits is not None else total).alias("score"))


def _tree_hits(index: Index, queries: Mapping[int, Query], scorer: Bm25, digits: int | None, exhaustive: bool) -> DataFrame:
    every = {k: leaves(q) for k, q in queries.items()}
    domains = {k: "all" if exhaustive else planner.domain_of(index, x) for k, x in every.items()}
    needs = Leaves()
    for x in every.values():
        needs.terms |= x.terms
        needs.prefixes |= x.prefixes
        needs.positions |= x.positions
    columns = ["term", "rowid", "tf", "doc_len", *(["positions"] if needs.positions else [])]
    needed = index.needed(needs.terms, needs.prefixes).select(*columns)
    frequencies = index.needed(needs.terms, needs.prefixes).groupBy("term").agg(F.count("*").alias("df"))
    weighed = needed.join(frequencies if needs.prefixes else F.broadcast(frequencies), "term")
    terms = {t: f"t{k}" for k, t in enumerate(sorted(needs.terms))}
    prefixes = {p: f"p{k}" for k, p in enumerate(sorted(needs.prefixes))}
    has = F.col("positions") if needs.positions else F.lit(True)
    pivot = [F.collect_list(F.struct("term", scorer.score(scorer.idf(F.col("df")), F.col("tf"), F.col("doc_len")).alias("s"))).alias("parts")]
    pivot += [F.max(F.when(F.col("term") == t, has)).alias(name) for t, name in terms.items()]
    for p, name in prefixes.items():
        own = F.when(F.col("term").startswith(p), has)
        pivot.append((F.flatten(F.collect_list(own)) if needs.positions else F.max(own)).alias(name))
    docs = weighed.groupBy("rowid").agg(*pivot)
    if "all" in domains.values():
        docs = index.docs.select("rowid").join(docs, "rowid", "left")

    def hit(k: int, q: Query) -> Column:
        own = every[k]

        def scores(x: Column) -> Column:
            plain = x["term"].isin(sorted(own.scoring_terms)) if own.scoring_terms else F.lit(False)
            return plain | any_of([x["term"].startswith(p) for p in sorted(own.scoring_prefixes)])

        parts = F.filter(F.coalesce("parts", F.array()), scores)
        total = scorer.total(parts)
        # A query without positional parts sees only whether its leaves are there.
        match = compile_query(q, lambda t: F.col(terms[t]), lambda p: F.col(prefixes[p]), needs.positions)
        if domains[k] == "scored":
            match = match & (F.size(parts) > 0)
        return F.when(match, F.struct(F.lit(k).cast("bigint").alias("query_id"), (F.round(total, digits) if digits is not None else total).alias("score")))

    hits = docs.select("rowid", F.explode(F.array(*[hit(k, q) for k, q in queries.items()])).alias("h")).where(F.col("h").isNotNull())
    return hits.select("h.query_id", "rowid", "h.score")


def search_many(index: Index, queries: Mapping[int, Query], options: SearchOptions | None = None, exhaustive: bool = False, precision: str = "float", digits: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``rowid``, ``score`` of each query's best ``limit`` documents."""
    options = (options or SearchOptions()).validated()
    scorer = Bm25(options.k1, options.b, *index.totals, precision)
    plain = {k: f for k, q in queries.items() if (f := flat(q))}
    trees = [(k, q) for k, q in queries.items() if k not in plain]
    parts = [_flat_hits(index, plain, scorer, digits)] if plain else []
    parts += [_tree_hits(index, dict(trees[at : at + TOGETHER]), scorer, digits, exhaustive) for at in range(0, len(trees), TOGETHER)]
    if not parts:
        return index.docs.sparkSession.createDataFrame([], f"query_id bigint, rank int, rowid bigint, score {precision}")
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*planner.order()))
    return found.withColumn("rank", rank).where(F.col("rank") <= options.limit).select("query_id", "rank", "rowid", "score")
