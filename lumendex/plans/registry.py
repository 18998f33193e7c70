"""The engine's registered queries and their SQL.

Comparisons with SQL use double precision, scores rounded to six digits, and rank by the rounded score, then by rowid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.bm25 import Bm25
from ..operators.index import Index, spread
from ..operators.query import All, SearchOptions, query
from ..sources.shared import fresh_path
from ..sources.store import Database, DatabaseConfig, Snapshot
from ..streaming.ingest import ingest_stream
from . import batch
from . import search as planner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- corpora -------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(_table(spark, sf_dir, "documents"), "doc_id", ["text"])


def _parts(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(_table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"])


_VERSIONS: dict[tuple[str, str], tuple[Database, dict[str, Snapshot]]] = {}


def _versions(spark: SparkSession, sf_dir: str, version: str = "later") -> tuple[Database, Snapshot]:
    """A store with a history, built once a session and table folder, as far as the named version at least, and that version's snapshot.

    "commits": all documents (generation 1); every third with another text (2); every seventh deleted (3). "compacted": the same, compacted. "later":
    every fifth deleted after that (4).
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VERSIONS:
        _VERSIONS[key] = Database(spark, fresh_path(spark, "store"), DatabaseConfig(query_cache_capacity=0)), {}
    db, kept = _VERSIONS[key]
    docs = _table(spark, sf_dir, "documents")
    gone = lambda n: docs.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("rowid"), F.lit("delete").alias("op"), F.lit(None).cast("array<string>").alias("fields"))

    def commits() -> None:
        db.upsert_df(docs, "doc_id", ["text"])
        db.upsert_df(docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("replaced the "), "text").alias("text")), "doc_id", ["text"])
        db.commit_ops(gone(7))

    steps = {"commits": commits, "compacted": lambda: db.optimize(vacuum=False), "later": lambda: db.commit_ops(gone(5))}
    for name, step in steps.items():
        if version in kept:
            break
        if name not in kept:
            try:
                step()
            except BaseException:
                del _VERSIONS[key]  # a half-built history isn't carried on
                raise
            kept[name] = db.snapshot()
    return db, kept[version]


# -- SQL building blocks -------------------------------------------------------------------

_TOKENS = r"""regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"""
_DOCS = "docs AS (SELECT doc_id AS rowid, 0 AS field, " + _TOKENS.format(text="text") + " AS toks FROM documents)"
_PARTS = (
    "docs AS (SELECT p_partkey AS rowid, 0 AS field, " + _TOKENS.format(text="p_name") + " AS toks FROM part "
    "UNION ALL SELECT p_partkey, 1, " + _TOKENS.format(text="p_type") + " FROM part)"
)
_LOG = (
    "log AS (SELECT doc_id AS rowid, 1 AS gen, 'upsert' AS op, text FROM documents "
    "UNION ALL SELECT doc_id, 2, 'upsert', 'replaced the ' || text FROM documents WHERE doc_id % 3 = 0 "
    "UNION ALL SELECT doc_id, 3, 'delete', NULL FROM documents WHERE doc_id % 7 = 0{more}), "
    "newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY gen DESC) = 1)"
)
_NEWEST = _LOG.format(more="")
_OF_NEWEST = ", docs AS (SELECT rowid, 0 AS field, " + _TOKENS.format(text="text") + " AS toks FROM newest WHERE op = 'upsert')"
_LIVE_DOCS = _NEWEST + _OF_NEWEST
_LATER_DOCS = _LOG.format(more=" UNION ALL SELECT doc_id, 4, 'delete', NULL FROM documents WHERE doc_id % 5 = 0") + _OF_NEWEST


def _ranked(corpus: str, match: str, scoring: str, k1: float = 1.2, b: float = 0.75, limit: int = 20, extra: str = "") -> str:
    """BM25 over a corpus. match: condition on ``lens`` l; scoring: condition on ``term``; without one, scores are 0."""
    return f"""
WITH {corpus},
occ AS (SELECT rowid, field, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM docs),
lens AS (SELECT rowid, sum(len(toks)) AS dl FROM docs GROUP BY rowid),
stats AS (SELECT count(*) AS n, greatest(sum(dl) / count(*), 1.0) AS avgdl FROM lens),
tf AS (SELECT term, rowid, count(*) AS tf FROM occ WHERE {scoring} GROUP BY term, rowid),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
  SELECT tf.rowid, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS s
  FROM tf JOIN df USING (term) JOIN lens ON lens.rowid = tf.rowid CROSS JOIN stats GROUP BY tf.rowid){extra}
SELECT l.rowid AS rowid, round(coalesce(s, 0.0), 6) AS score FROM lens l LEFT JOIN scores USING (rowid)
WHERE {match} ORDER BY score DESC, rowid LIMIT {limit}"""


def _has(condition: str) -> str:
    return f"l.rowid IN (SELECT rowid FROM occ WHERE {condition})"


_SCORED = "s IS NOT NULL"


def _search(index: Index, q, limit: int = 20, exhaustive: bool = False, **options) -> DataFrame:
    return planner.search_df(index, q, SearchOptions(limit=limit, **options), exhaustive, fields=False, precision="double", digits=6)


# -- text analysis and index ---------------------------------------------------------------


@registered("WITH " + _DOCS + " SELECT unnest(toks) AS term, count(*) AS occurrences FROM docs GROUP BY 1")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("text")).select(F.explode(analysis.tokens(F.col("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("occurrences"))


@registered("WITH " + _DOCS + " SELECT rowid, len(toks) AS doc_len FROM docs")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).docs.select("rowid", F.col("doc_len").cast("bigint").alias("doc_len"))


@registered("WITH " + _DOCS + ", t AS (SELECT DISTINCT rowid, unnest(toks) AS term FROM docs) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"))


@registered("WITH " + _DOCS + " SELECT count(*) AS live_docs, sum(len(toks))::BIGINT AS total_doc_len, round(sum(len(toks)) / count(*), 6) AS avgdl FROM docs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).docs
    return docs.agg(F.count("*").alias("live_docs"), F.sum("doc_len").alias("total_doc_len"), F.round(F.sum("doc_len") / F.count("*"), 6).alias("avgdl"))


@registered(
    "WITH " + _DOCS + ", occ AS (SELECT rowid, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM docs) "
    "SELECT term, rowid, count(*) AS tf, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS positions FROM occ GROUP BY term, rowid"
)
def postings_tf_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).postings
    return rows.select("term", "rowid", F.col("tf").cast("bigint").alias("tf"), F.md5(F.array_join(F.col("positions").cast("array<string>"), ",")).alias("positions"))


@registered(
    "WITH " + _DOCS + ", t AS (SELECT DISTINCT rowid, unnest(toks) AS term FROM docs), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM docs) "
    "SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d, n"
)
def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents(spark, sf_dir)
    scorer = Bm25(1.2, 0.75, *index.totals, "double")
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.round(scorer.idf(F.col("df")), 6).alias("idf"))


# -- boolean queries -----------------------------------------------------------------------


@registered(_ranked(_DOCS, _SCORED, "term = 'the'"))
def search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.term("The"))


@registered(_ranked(_DOCS, _SCORED, "term IN ('the', 'of', 'tion')"))
def search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.or_([query.term(t) for t in ("the", "of", "tion")]))


@registered(_ranked(_DOCS, " AND ".join(_has(f"term = '{t}'") for t in ("the", "of", "tion")), "term IN ('the', 'of', 'tion')"))
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.and_([query.term(t) for t in ("the", "of", "tion")]))


@registered(_ranked(_DOCS, _SCORED, "starts_with(term, 'thre')"))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.prefix("thre"))


@registered(_ranked(_DOCS, _has("term = 'the'") + " AND NOT " + _has("term = 'of'"), "term = 'the'"))
def search_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.and_([query.term("the"), query.negate(query.term("of"))]))


@registered(_ranked(_DOCS, "NOT " + _has("term = 'the'"), "false"))
def search_not_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.negate(query.term("the")))


@registered(_ranked(_DOCS, _has("term = 'the'"), "false"))
def search_double_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.negate(query.negate(query.term("the"))))


@registered(_ranked(_DOCS, "true", "false"))
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), All())


@registered(_ranked(_DOCS, "true", "false"))
def search_empty_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.and_([]))


@registered(_ranked(_DOCS, "false", "false"))
def search_empty_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.or_([]))


@registered(_ranked(_DOCS, _SCORED + " AND (starts_with_p OR NOT has_of)".replace("starts_with_p", _has("starts_with(term, 'thre')")).replace("has_of", _has("term = 'of'")), "starts_with(term, 'thre')", limit=1000000))
def search_or_not_scored_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.or_([query.prefix("thre"), query.negate(query.term("of"))]), limit=1_000_000)


@registered(_ranked(_DOCS, "(" + _has("starts_with(term, 'thre')") + " OR NOT " + _has("term = 'of'") + ")", "starts_with(term, 'thre')", limit=1000000))
def search_or_not_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.or_([query.prefix("thre"), query.negate(query.term("of"))]), limit=1_000_000, exhaustive=True)


@registered(_ranked(_DOCS, "((" + _has("term = 'the'") + " AND " + _has("term = 'tion'") + ") OR " + _has("term = 'of'") + ")", "term IN ('the', 'tion', 'of')", limit=50))
def search_mixed_tree_global_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = query.or_([query.and_([query.term("the"), query.term("tion")]), query.term("of")])
    return _search(_documents(spark, sf_dir), tree, limit=50)


@registered(_ranked(_DOCS, _SCORED, "term IN ('the', 'of')", k1=0.4, b=0.0))
def search_k1_b_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.or_([query.term("the"), query.term("of")]), k1=0.4, b=0.0)


# -- positional queries --------------------------------------------------------------------

_AFTER = "l.rowid IN (SELECT a.rowid FROM occ a JOIN occ b ON a.rowid = b.rowid AND a.field = b.field AND {how} WHERE a.term = '{a}' AND b.term = '{b}'{more})"


@registered(_ranked(_DOCS, _AFTER.format(how="b.pos = a.pos + 1", a="of", b="the", more=""), "term IN ('of', 'the')"))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.phrase(["of", "the"]))


@registered(_ranked(_DOCS, _AFTER.format(how="abs(b.pos - a.pos) <= 3", a="of", b="tion", more=""), "term IN ('of', 'tion')"))
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.near(["of", "tion"], 3))


@registered(_ranked(_DOCS, _AFTER.format(how="b.pos > a.pos AND b.pos - a.pos <= 2", a="of", b="of", more=""), "term = 'of'"))
def search_near_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_documents(spark, sf_dir), query.near(["of", "of"], 2))


@registered(_ranked(_PARTS, _has("field = 1 AND term IN (SELECT min(term) FROM occ WHERE field = 1)"), "term IN (SELECT min(term) FROM occ WHERE field = 1)"))
def search_column_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _parts(spark, sf_dir)
    rare = _table(spark, sf_dir, "part").select(F.explode(analysis.tokens(F.col("p_type"))).alias("t")).agg(F.min("t")).first()[0]
    return _search(index, query.column(1, query.term(rare)))


@registered(_ranked(_PARTS, "NOT " + _has("field = 0 AND starts_with(term, 'b')"), "false", limit=1000000))
def search_column_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_parts(spark, sf_dir), query.column(0, query.negate(query.prefix("b"))), limit=1_000_000)


@registered(
    _ranked(
        _PARTS,
        "l.rowid IN (SELECT a.rowid FROM occ a JOIN occ b ON a.rowid = b.rowid AND a.field = b.field AND b.pos = a.pos + 1, pair p WHERE a.field = 0 AND a.term = p.x AND b.term = p.y)",
        "term IN (SELECT x FROM pair UNION SELECT y FROM pair)",
    ).replace("lens AS", "pair AS (SELECT toks[1] AS x, toks[2] AS y FROM docs WHERE field = 0 ORDER BY rowid LIMIT 1),\nlens AS", 1)
)
def search_column_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "part").orderBy("p_partkey").select(analysis.tokens(F.col("p_name")).alias("t")).first().t
    return _search(_parts(spark, sf_dir), query.column(0, query.phrase(first[:2])))


@registered(_ranked(_PARTS, "false", "false"))
def search_column_nested_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_parts(spark, sf_dir), query.column(0, query.column(1, query.prefix(""))))


@registered(_ranked(_PARTS, _SCORED, "starts_with(term, 's')", limit=300))
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_parts(spark, sf_dir), query.prefix("s"), limit=300)


@registered("SELECT * FROM (VALUES (7::BIGINT, '百花'), (8::BIGINT, '百花')) t(rowid, hit)")
def cjk_bigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(7, ["春天来了百花盛开"]), (8, ["x", "百花"]), (9, ["百", "花"])], "rowid long, fields array<string>")
    return _search(Index.of(docs), query.term("百花")).select("rowid", F.lit("百花").alias("hit"))


_BATCH = {0: "search_term", 1: "search_and_not", 2: "search_prefix", 3: "search_phrase", 4: "search_not_only"}


@registered(" UNION ALL ".join(f"SELECT {k}::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, rowid) AS rank, rowid, score FROM ({ORACLES[n]})" for k, n in _BATCH.items()))
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = [query.term("the"), query.and_([query.term("the"), query.negate(query.term("of"))]), query.prefix("thre"), query.phrase(["of", "the"]), query.negate(query.term("the"))]
    found = batch.search_many(_documents(spark, sf_dir), dict(enumerate(trees)), SearchOptions(limit=20), precision="double", digits=6)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "rowid", "score")


# -- hits ----------------------------------------------------------------------------------


@registered("SELECT rowid, round(score, 3) AS score FROM (" + ORACLES["search_or"] + ")")
def search_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's own precision."""
    found = planner.search_df(_documents(spark, sf_dir), query.or_([query.term(t) for t in ("the", "of", "tion")]), SearchOptions(limit=20), fields=False)
    return found.select("rowid", F.round(F.col("score").cast("double"), 3).alias("score"))


@registered("SELECT rowid, md5(text) AS digest FROM (" + ORACLES["search_prefix"] + ") JOIN documents ON doc_id = rowid")
def search_stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planner.search_df(_documents(spark, sf_dir), query.prefix("thre"), SearchOptions(limit=20), precision="double", digits=6)
    return found.select("rowid", F.md5(F.col("fields")[0]).alias("digest"))


# -- the store -----------------------------------------------------------------------------


_REPLACED = _ranked(_LIVE_DOCS, _SCORED, "term IN ('replaced', 'of')")


def _replaced(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    return _search(_versions(spark, sf_dir, version)[1].index(), query.or_([query.term("replaced"), query.term("of")]))


@registered("WITH " + _NEWEST + " SELECT rowid, gen::BIGINT AS generation, md5(text) AS digest FROM newest WHERE op = 'upsert'")
def upsert_delete_visible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir, "commits")[1].live().select("rowid", "generation", F.md5(F.col("fields")[0]).alias("digest"))


@registered(_REPLACED)
def search_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, "commits")


@registered(_REPLACED)
def search_after_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, "compacted")


@registered(_ranked(_LATER_DOCS, _SCORED, "term IN ('replaced', 'of')"))
def search_live_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the compacted postings, less those that a later commit deleted."""
    return _replaced(spark, sf_dir, "later")


@registered(_ranked(_LATER_DOCS, _has("term = 'replaced'") + " AND " + _has("term = 'tion'"), "term IN ('replaced', 'tion')"))
def search_and_after_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(_versions(spark, sf_dir, "later")[1].index(), query.and_([query.term("replaced"), query.term("tion")]))


@registered("WITH " + _LATER_DOCS + " SELECT count(*) AS live_docs, sum(len(toks))::BIGINT AS total_doc_len, 4::BIGINT AS generation FROM docs")
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, _ = _versions(spark, sf_dir, "later")
    return spark.createDataFrame([(len(db), db.snapshot().index().totals[1], db.generation)], "live_docs long, total_doc_len long, generation long")


@registered("WITH " + _LATER_DOCS.replace(_OF_NEWEST, "") + " SELECT rowid, text FROM newest WHERE op = 'upsert' AND rowid IN (42, 43, 44, 45, 48)")
def get_by_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted row, one as it was first, and replaced ones."""
    db, _ = _versions(spark, sf_dir, "later")
    found = {k: db.get(k) for k in (42, 43, 44, 45, 48)}
    return spark.createDataFrame([(k, v[0]) for k, v in found.items() if v], "rowid long, text string")


@registered("WITH " + _NEWEST + " SELECT rowid, op, gen::BIGINT AS generation FROM newest")
def last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir, "commits")[1].newest_ops()


@registered("SELECT doc_id AS rowid, 1::BIGINT AS generation, md5(text) AS digest FROM documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, ingested twice under one name, which commits them once."""
    db = Database(spark, fresh_path(spark, "store"))
    # A pattern, as the table may be one file or a folder.
    stream = spark.readStream.schema(_table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    for _ in range(2):
        ingest_stream(db, stream, "doc_id", ["text"], "documents", fresh_path(spark, "progress")).awaitTermination()
    return db.snapshot().live().select("rowid", "generation", F.md5(F.col("fields")[0]).alias("digest"))
