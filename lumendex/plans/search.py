"""The planner: postings -> pivot by document -> boolean filter -> BM25 -> top k -> stored fields.

Ranking works on narrow rows; the fields of the few hits are fetched at the end. Positions are read only by queries that look at
them. Document frequencies of plain terms are asked for first (one number a term); those of prefixes may be
the whole dictionary and are joined as Spark sees fit. The shape of a query decides what is shuffled: one term alone needs no exchange, as it has one posting a
document; where documents must have some terms, only those in the rarest one's list are.
"""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25
from ..operators.index import Index, matches_leaf
from ..operators.matching import compile_query
from ..operators.query import And, Column, Leaves, Near, Phrase, Query, SearchOptions, Term, leaves

#: Hits whose fields are fetched by their rowids.
FEW = 1000


def domain_of(index: Index, found: Leaves) -> str:
    """"scored": only documents with a scoring term are looked at; "all" if the query has none (a prefix counts if it has live terms)."""
    if found.scoring_terms:
        return "scored"
    if found.scoring_prefixes and not index.needed(set(), found.scoring_prefixes).limit(1).isEmpty():
        return "scored"
    return "all"


def required_terms(node: Query) -> set[str]:
    """Terms that every match has."""
    if isinstance(node, Term):
        return {node.text}
    if isinstance(node, (Phrase, Near)):
        return set(node.terms)
    if isinstance(node, And):
        return set().union(*map(required_terms, node.children))
    return required_terms(node.child) if isinstance(node, Column) else set()


def shape_of(found: Leaves, required: set[str]) -> str:
    """"single": one term's list; "flat": lists that are cut to the rarest of them; "general": all lists as they are."""
    if len(found.terms) == 1 and not found.prefixes:
        return "single"
    return "flat" if required else "general"


def ranked(index: Index, query: Query, options: SearchOptions, exhaustive: bool = False, precision: str = "float", digits: int | None = None, seen: tuple[Observation, Observation] | None = None) -> DataFrame:
    """``rowid``, ``score`` of all matching documents, unordered.

    digits: round scores. seen: observations that count the documents looked at, and those that match.
    """
    found = leaves(query)
    domain = "all" if exhaustive else domain_of(index, found)
    required = set() if exhaustive else required_terms(query)
    shape = shape_of(found, required)
    counts = index.frequencies(found.scoring_terms | required)
    scorer = Bm25(options.k1, options.b, *index.totals, precision)
    columns = ["term", "rowid", "tf", "doc_len", *(["positions"] if found.positions else [])]
    needed = index.needed(found.terms, found.prefixes, {t: counts[t] for t in required}).select(*columns)
    scoring = matches_leaf(found.scoring_terms, found.scoring_prefixes)
    if found.scoring_prefixes:
        frequencies = index.needed(found.scoring_terms, found.scoring_prefixes).groupBy("term").agg(F.count("*").alias("df"))
        weighed, df = needed.join(frequencies, "term", "left"), F.col("df")
    else:
        weighed = needed
        df = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in sorted(counts.items())], F.lit(0))
    part = F.when(scoring, F.struct("term", scorer.score(scorer.idf(df), F.col("tf"), F.col("doc_len")).alias("s")))

    # Leaves are named by their ordinal, never by their text.
    terms = {t: f"t{k}" for k, t in enumerate(sorted(found.terms))}
    prefixes = {p: f"p{k}" for k, p in enumerate(sorted(found.prefixes))}
    has = F.col("positions") if found.positions else F.lit(True)
    if shape == "single":
        docs = weighed.select("rowid", F.filter(F.array(part), lambda x: x.isNotNull()).alias("parts"), has.alias("t0"))
    else:
        pivot = [F.collect_list(part).alias("parts")]
        pivot += [F.max(F.when(F.col("term") == t, has)).alias(name) for t, name in terms.items()]
        for p, name in prefixes.items():
            own = F.when(F.col("term").startswith(p), has)
            pivot.append((F.flatten(F.collect_list(own)) if found.positions else F.max(own)).alias(name))
        docs = weighed.groupBy("rowid").agg(*pivot)
    if domain == "scored":
        docs = docs.where(F.size("parts") > 0)
    else:
        docs = index.docs.select("rowid").join(docs, "rowid", "left")
    if seen:
        docs = docs.observe(seen[0], F.count("*").alias("n"))
    matches = compile_query(query, lambda t: F.col(terms[t]), lambda p: F.col(prefixes[p]), found.positions)
    total = F.coalesce(scorer.total(F.col("parts")), F.lit(0.0).cast(precision))
    hits = docs.where(matches).select("rowid", (F.round(total, digits) if digits is not None else total).alias("score"))
    if seen:
        hits = hits.observe(seen[1], F.count("*").alias("n"))
    return hits


def order() -> list[Col]:
    return [F.desc("score"), F.asc("rowid")]


def search_df(index: Index, query: Query, options: SearchOptions | None = None, exhaustive: bool = False, fields: bool = True, **how) -> DataFrame:
    """The best ``limit`` documents: ``rowid``, ``score`` and (unless told not to) ``fields``, best first.

    Fields of up to FEW hits are fetched by their rowids, which reach the scan, so hits are ranked at once; others are joined.
    """
    options = (options or SearchOptions()).validated()
    top = ranked(index, query, options, exhaustive, **how).orderBy(*order()).limit(options.limit)
    if not fields:
        return top
    if options.limit > FEW:
        return index.docs.select("rowid", "fields").join(top, "rowid").select("rowid", "score", "fields").orderBy(*order())
    hits = top.collect()
    found = index.docs.where(F.col("rowid").isin([h.rowid for h in hits])).select("rowid", "fields")
    scores = index.docs.sparkSession.createDataFrame(hits, top.schema)
    return found.join(F.broadcast(scores), "rowid").select("rowid", "score", "fields").orderBy(*order())
