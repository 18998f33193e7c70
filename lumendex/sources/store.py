"""A transactional store of documents and their index on Parquet.

``_manifest/<number>.json`` names all folders of a version; creating the next number, which only one writer can, publishes a commit.
``commits/<id>/ops`` and ``commits/<id>/postings`` hold a commit, ``base/<id>/docs`` and ``base/<id>/postings`` what
``optimize`` compacted. A folder that no manifest names is invisible. A snapshot is one manifest, so readers are isolated.

Which rows of the base and of the commits are live is told by the commits' row numbers, generations and operations alone; these are broadcast as words of 64
neighbouring row numbers, up to ``MOST_BROADCAST`` words, so documents and postings are filtered where they lie, and fields are read only by what asks for them.
"""

from __future__ import annotations

import json
import threading
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Corrupt, InvalidInput, TransactionClosed
from ..functions.analysis import MAX_FIELDS
from ..operators import index as indexing
from ..operators.query import Query, SearchHit, SearchOptions, SearchResult, SearchStats
from ..plans import search as planner
from .files import Files

FORMAT = 2
#: Words of 64 neighbouring row numbers, with a generation and a bit for each number, that are broadcast at most (some 100 bytes each): 64 million operations
#: on row numbers that lie together, a million if they lie far apart.
MOST_BROADCAST = 1_000_000
#: Bytes of stored operations whose postings a task sorts at most (some 20 times as much in memory).
SORTED_AT_ONCE = 16 << 20
OPS = T.StructType([T.StructField("rowid", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("fields", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class DatabaseConfig:
    """resident: keep the live index in the executors' memory (or on their disks) between searches. recover: open at the newest
    good manifest, and remove damaged ones after it, rather than refuse; their commits are lost."""

    query_cache_capacity: int = 256
    resident: bool = False
    recover: bool = False


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    generation: int = 0
    format_version: int = FORMAT
    base: str | None = None
    base_generation: int = 0
    #: (folder, generation) of each commit after the base.
    commits: tuple[tuple[str, int], ...] = ()
    #: Last batch of each named stream that was committed.
    batches: tuple[tuple[str, int], ...] = ()
    #: Documents and tokens of the base, where known.
    base_totals: tuple[int, int] | None = None
    #: Words of 64 row numbers (older stores: operations, which are no fewer) of each commit after the base, by folder, where known.
    sizes: tuple[tuple[str, int], ...] = ()

    def to_bytes(self) -> bytes:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc32": zlib.crc32(body.encode()), "manifest": body}).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Manifest:
        try:
            outer = json.loads(data)
            if zlib.crc32(outer["manifest"].encode()) != outer["crc32"]:
                raise Corrupt("manifest checksum mismatch")
            inner = json.loads(outer["manifest"])
            inner["commits"] = tuple((p, g) for p, g in inner["commits"])
            inner["batches"] = tuple((s, b) for s, b in inner["batches"])
            inner["sizes"] = tuple((p, n) for p, n in inner.get("sizes", ()))
            inner["base_totals"] = tuple(inner["base_totals"]) if inner.get("base_totals") else None
            found = cls(**inner)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise Corrupt("manifest can't be read") from e
        if found.format_version not in (1, FORMAT):
            raise Corrupt("unknown format version")
        order = [found.base_generation, *[g for _, g in found.commits]]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)) or order[-1] > found.generation:
            raise Corrupt("generations don't increase")
        return found


_COLUMNS = {"docs": ["rowid", "op", "fields", "doc_len", "generation"], "postings": ["term", "rowid", "tf", "doc_len", "positions", "generation"]}


def _word() -> Column:
    """The word of 64 neighbouring row numbers that ``rowid`` is in."""
    return F.shiftright("rowid", 6)


def _bit() -> Column:
    """The bit of ``rowid`` in its word."""
    return F.expr("shiftleft(1L, cast(rowid & 63 as int))")


def _newest_of(ops: DataFrame) -> DataFrame:
    """rowid, generation, op of the newest operation of each row number. Both travel as one number, so that they are aggregated by hash, before and after the exchange."""
    both = F.max(F.col("generation") * 2 + (F.col("op") == "upsert").cast("bigint")).alias("both")
    newest = ops.groupBy("rowid").agg(both)
    return newest.select("rowid", F.expr("both div 2").alias("generation"), F.when(F.col("both") % 2 == 1, "upsert").otherwise("delete").alias("op"))


@dataclass
class Snapshot:
    """One version of the store."""

    spark: SparkSession
    files: Files
    manifest: Manifest
    resident: bool = False
    _index: indexing.Index | None = field(default=None)

    def _base(self, kind: str) -> DataFrame | None:
        """Docs or postings of the base, with its generation."""
        m = self.manifest
        if not m.base:
            return None
        rows = self.spark.read.parquet(self.files.url(f"{m.base}/{kind}")).withColumn("generation", F.lit(m.base_generation).cast("bigint"))
        return rows.withColumn("op", F.lit("upsert")).select(*_COLUMNS[kind]) if kind == "docs" else rows.select(*_COLUMNS[kind])

    def _commits(self, kind: str) -> DataFrame | None:
        """Operations or postings of all commits after the base, with their generations."""
        m, name = self.manifest, "ops" if kind == "docs" else "postings"
        if not m.commits:
            return None
        generations = F.create_map(*[F.lit(x) for p, g in m.commits for x in (p.rsplit("/", 1)[1], g)])
        rows = self.spark.read.parquet(*[self.files.url(f"{p}/{name}") for p, _ in m.commits])
        return rows.withColumn("generation", F.element_at(generations, F.col("commit")).cast("bigint")).select(*_COLUMNS[kind])

    def _rows(self, kind: str) -> DataFrame | None:
        parts = [p for p in (self._base(kind), self._commits(kind)) if p is not None]
        return parts[0].unionByName(parts[-1]) if len(parts) == 2 else parts[0] if parts else None

    def _live_rows(self, kind: str, rowid: int | None = None) -> DataFrame | None:
        """Those rows that the newest operation of their row number left: of the base what no commit names, of commits what none after names.

        rowid: only rows of this number; the condition reaches all scans.
        """
        asked = F.lit(True) if rowid is None else F.col("rowid") == rowid
        base, commits = (rows if rows is None else rows.where(asked) for rows in (self._base(kind), self._commits(kind)))
        if commits is None:
            return base
        if base is None and len(self.manifest.commits) == 1:  # an only commit names each row once
            return commits.where("op = 'upsert'") if kind == "docs" else commits
        # Only narrow columns of the commits are read and shuffled.
        newest = _newest_of(self._commits("docs").where(asked))
        upserts = newest.where("op = 'upsert'")
        sizes = dict(self.manifest.sizes)
        few = sum(sizes.get(p, MOST_BROADCAST + 1) for p, _ in self.manifest.commits) <= MOST_BROADCAST
        if few:
            bits = F.bit_or(_bit()).alias("bits")
            changed = F.broadcast(newest.groupBy(_word().alias("word")).agg(bits))
            kept = F.broadcast(upserts.groupBy(_word().alias("word"), F.col("generation").alias("at")).agg(bits))
            named = (_word() == F.col("word")) & (F.col("bits").bitwiseAND(_bit()) != 0)
            live = commits.join(kept, named & (F.col("generation") == F.col("at")), "left_semi")
            rest = base.join(changed, named, "left_anti") if base is not None else None
        else:
            live = commits.join(upserts.select("rowid", "generation"), ["rowid", "generation"], "left_semi")
            rest = base.join(newest.select("rowid"), "rowid", "left_anti") if base is not None else None
        live = live.select(*_COLUMNS[kind])
        return live if rest is None else rest.select(*_COLUMNS[kind]).unionByName(live)

    def live(self, rowid: int | None = None) -> DataFrame:
        """rowid, fields, doc_len, generation of live documents (or of that one): the newest operation of each row, if it is an upsert."""
        rows = self._live_rows("docs", rowid)
        if rows is None:
            return self.spark.createDataFrame([], "rowid long, fields array<string>, doc_len int, generation long")
        return rows.select("rowid", "fields", "doc_len", "generation")

    def newest_ops(self) -> DataFrame:
        """rowid, op, generation of the newest operation of each row number that the base or a commit names."""
        rows = self._rows("docs")
        if rows is None:
            return self.spark.createDataFrame([], "rowid long, op string, generation long")
        return _newest_of(rows).select("rowid", "op", "generation")

    def index(self) -> indexing.Index:
        if self._index is None:
            m, live = self.manifest, self.live()
            postings = None if m.format_version == 1 else self._live_rows("postings")
            if postings is None:  # documents only: indexed anew
                postings = indexing.build_postings(live)
            docs, postings = live.drop("generation"), postings.select("term", "rowid", "tf", "doc_len", "positions")
            if self.resident:
                docs, postings = docs.select("rowid", "fields", "doc_len").persist(), postings.persist()
            self._index = indexing.Index(docs, postings, len(m.commits) + bool(m.base), known=None if m.commits else m.base_totals)
        return self._index

    def release(self) -> None:
        """Give up what was kept in memory."""
        if self._index is not None and self.resident:
            self._index.docs.unpersist()
            self._index.postings.unpersist()


class Database:
    """A store in a folder. Handles may be shared between threads; several writers, also of other processes, may commit."""

    def __init__(self, spark: SparkSession, path: str, config: DatabaseConfig | None = None):
        self.spark, self.config = spark, config or DatabaseConfig()
        self.files = Files(spark, path)
        self.files.make_dir("_manifest")
        self._lock = threading.Lock()
        self._cache: OrderedDict[tuple, SearchResult] = OrderedDict()
        self._snapshot: Snapshot | None = None
        self.refresh()

    # -- versions --------------------------------------------------------------------------

    def _newest(self) -> Manifest:
        names = [n for n in self.files.names("_manifest") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return Manifest()
        numbers = [int(n.removesuffix(".json")) for n in names]
        if numbers != list(range(numbers[0], numbers[-1] + 1)):
            raise Corrupt("a manifest is missing")
        # The newest must be good, unless recovery is asked for: an older one would silently lose commits.
        try:
            found = Manifest.from_bytes(self.files.read(f"_manifest/{names[-1]}"))
        except Corrupt:
            if not self.config.recover or len(names) == 1:
                raise
            self.files.delete(f"_manifest/{names[-1]}")
            return self._newest()
        if found.number != numbers[-1]:
            raise Corrupt("manifest has another number than its name")
        return found

    def refresh(self) -> Snapshot:
        """See what other writers have committed."""
        newest = self._newest()
        with self._lock:
            if self._snapshot is None or self._snapshot.manifest != newest:
                if self._snapshot is not None:
                    self._snapshot.release()
                self._snapshot = Snapshot(self.spark, self.files, newest, self.config.resident)
                self._cache.clear()
            return self._snapshot

    def snapshot(self) -> Snapshot:
        with self._lock:
            assert self._snapshot is not None
            return self._snapshot

    def _publish(self, change) -> Manifest:
        """Publish what ``change`` makes of the newest manifest; on a clash with another writer once more from its result."""
        while True:
            now = self._newest()
            new = replace(change(now), number=now.number + 1)
            if new.generation == now.generation and new == replace(now, number=now.number + 1):
                return now
            if self.files.publish(f"_manifest/{new.number:020d}.json", new.to_bytes()):
                self.refresh()
                return new

    @property
    def generation(self) -> int:
        return self.snapshot().manifest.generation

    def __len__(self) -> int:
        return self.snapshot().index().totals[0]

    def is_empty(self) -> bool:
        return len(self) == 0

    # -- writing ---------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self)

    def has_batch(self, name: str, number: int) -> bool:
        """Whether this batch of a stream, or a later one, was committed, by whatever handle."""
        return dict(self.refresh().manifest.batches).get(name, -1) >= number

    def commit_ops(self, ops: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Commit a DataFrame of operations (rowid, op, fields), one a row at most; its size may be any. Gives the generation (without operations the current one).

        batch: a stream's name and batch number; a batch that was committed before isn't again.
        """
        if batch and self.has_batch(*batch):
            return self.generation
        if self._newest().format_version == 1:
            self.optimize()
        commit = uuid.uuid4().hex
        folder = f"commits/{commit}"
        fields = F.col("fields")
        whole = fields.isNotNull() & ~F.exists(fields, lambda x: x.isNull()) & F.size(fields).between(1, MAX_FIELDS)
        good = F.col("rowid").isNotNull() & ((F.col("op") == "delete") | ((F.col("op") == "upsert") & whole))
        # Counted while they are written; a task that runs again may count twice, so only whether there are any matters.
        seen = Observation()
        told = ops.select("rowid", "op", "fields").observe(seen, F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("bad"))
        rows = indexing.with_lengths(indexing.spread(told)).withColumn("commit", F.lit(commit))
        rows.write.option("parquet.block.size", SORTED_AT_ONCE).parquet(self.files.url(f"{folder}/ops"))
        bad = seen.get.get("bad", 0)
        stored = self.spark.read.schema(rows.schema).parquet(self.files.url(f"{folder}/ops"))
        by_word = stored.groupBy(_word().alias("word")).agg(F.count("*").alias("n"), F.bit_count(F.bit_or(_bit())).alias("ids"))
        count, ids, words = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ids"), F.lit(0)), F.count("*")).first()
        if bad or ids < count or not count:
            self.files.delete(folder)
            if bad:
                raise InvalidInput(f"operations must be an upsert or a delete, with a rowid, and upserts with 1 to {MAX_FIELDS} fields that aren't null")
            if ids < count:
                raise InvalidInput("a commit takes one operation for each rowid")
            return self.generation
        upserts = self._finely().read.schema(rows.schema).parquet(self.files.url(f"{folder}/ops")).where("op = 'upsert'")
        postings = indexing.build_postings(upserts).sortWithinPartitions("term", "rowid").withColumn("commit", F.lit(commit))
        postings.write.parquet(self.files.url(f"{folder}/postings"))

        def add(now: Manifest) -> Manifest:
            done = dict(now.batches)
            if batch and done.get(batch[0], -1) >= batch[1]:
                return now
            done |= dict([batch] if batch else [])
            generation = now.generation + 1
            return replace(now, generation=generation, format_version=FORMAT, commits=(*now.commits, (folder, generation)), sizes=(*now.sizes, (folder, words)), batches=tuple(sorted(done.items())))

        return self._publish(add).generation

    def _finely(self) -> SparkSession:
        """A session like this one whose scans are cut finely enough that a sort of what they give stays in memory, whatever the table's size."""
        fine = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        own = self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        fine.conf.set("spark.sql.files.maxPartitionBytes", str(min(own, SORTED_AT_ONCE)))
        return fine

    def upsert_df(self, df: DataFrame, rowid: str, fields: list[str] | str, batch: tuple[str, int] | None = None) -> int:
        """Commit all rows of a DataFrame. fields: string columns, or one array column. Of equal rowids one row must be given."""
        own = F.array(*[F.col(f) for f in fields]) if isinstance(fields, list) else F.col(fields)
        ops = df.select(F.col(rowid).cast("bigint").alias("rowid"), F.lit("upsert").alias("op"), own.alias("fields"))
        return self.commit_ops(ops, batch)

    def optimize(self, vacuum: bool = True) -> None:
        """Compact to live documents and their postings (which aren't made anew) and (unless told not to) remove what no manifest needs."""
        before = self.refresh()
        base = f"base/{uuid.uuid4().hex}"
        own = before.index()
        own.docs.sort("rowid").write.parquet(self.files.url(f"{base}/docs"))
        counted = self.spark.read.parquet(self.files.url(f"{base}/docs")).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
        self._by_term(own.postings, before.manifest).write.parquet(self.files.url(f"{base}/postings"))
        seen = before.manifest

        def swap(now: Manifest) -> Manifest:
            # Commits that came meanwhile stay on top of the new base.
            later = tuple(c for c in now.commits if c not in seen.commits)
            sizes = tuple((p, n) for p, n in now.sizes if p in {c for c, _ in later})
            return replace(now, format_version=FORMAT, base=base, base_generation=seen.generation, base_totals=(counted.n, counted.t), commits=later, sizes=sizes)

        self._publish(swap)
        if vacuum:
            self.vacuum()

    def _by_term(self, postings: DataFrame, m: Manifest) -> DataFrame:
        """Sorted by term and rowid, in so many parts that each is sorted in memory, whatever the table's size."""
        stored = sum(self.files.size(f"{folder}/postings") for folder in (m.base, *[p for p, _ in m.commits]) if folder)
        parts = -(-stored // (2 * SORTED_AT_ONCE))
        if parts <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return postings.sort("term", "rowid")
        return postings.repartitionByRange(parts, "term", "rowid").sortWithinPartitions("term", "rowid")

    def vacuum(self, orphans: bool = False) -> None:
        """Delete older manifests and the folders that only they name. Other handles must refresh.

        orphans: also folders that no manifest names, as failed commits leave; then no commit may be under way.
        """
        now = self._newest()
        used = {now.base, *[p for p, _ in now.commits]}
        gone: set[str] = set()
        for name in self.files.names("_manifest"):
            if name.endswith(".json") and name < f"{now.number:020d}.json":
                old = Manifest.from_bytes(self.files.read(f"_manifest/{name}"))
                gone |= {p for p in (old.base, *[p for p, _ in old.commits]) if p and p not in used}
                self.files.delete(f"_manifest/{name}")
        if orphans:
            gone |= {f"{kind}/{name}" for kind in ("base", "commits") for name in self.files.names(kind) if f"{kind}/{name}" not in used}
        for folder in sorted(gone):
            self.files.delete(folder)

    def verify(self) -> None:
        """Check the checksums of all stored pages, and the stored index against the stored documents; Corrupt if any is wrong."""
        found = self.snapshot()
        m = found.manifest
        kinds = ["docs"] if m.format_version == 1 else ["docs", "postings"]
        folders = [f"{m.base}/{kind}" for kind in kinds if m.base] + [f"{p}/{kind}" for p, _ in m.commits for kind in ("ops", "postings")]
        for folder in folders:
            rows = self.spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(self.files.url(folder))
            try:
                rows.agg(F.bit_xor(F.xxhash64(*rows.columns))).collect()
            except (PySparkException, Py4JJavaError) as e:
                raise Corrupt(f"{folder} can't be read") from e
        live, own = found.live(), found.index()
        rows = found._rows("postings")
        if rows is None:
            return
        bad = rows.where((F.col("tf") != F.size("positions")) | (F.col("tf") < 1) | (F.col("term") == "") | (F.sort_array(F.array_distinct("positions")) != F.col("positions")))
        if not bad.isEmpty():
            raise Corrupt("postings are inconsistent")
        if not own.postings.groupBy("term", "rowid").count().where("count > 1").isEmpty():
            raise Corrupt("a posting is there twice")
        sums = own.postings.groupBy("rowid").agg(F.sum("tf").alias("tokens"))
        if not live.join(sums, "rowid", "full").where(~F.coalesce("tokens", F.lit(0)).eqNullSafe(F.col("doc_len"))).isEmpty():
            raise Corrupt("postings and documents disagree")
        if not live.groupBy("rowid").count().where("count > 1").isEmpty():
            raise Corrupt("a document is there twice")

    # -- reading ---------------------------------------------------------------------------

    def get(self, rowid: int) -> list[str] | None:
        row = self.snapshot().live(rowid).select("fields").first()
        return list(row.fields) if row else None

    def search_df(self, query: Query, options: SearchOptions | None = None, exhaustive: bool = False) -> DataFrame:
        return planner.search_df(self.snapshot().index(), query, options, exhaustive)

    def search(self, query: Query, options: SearchOptions | None = None) -> SearchResult:
        options = (options or SearchOptions()).validated()
        own = self.snapshot()
        key = (own.manifest.number, query, options.limit, options.k1, options.b)
        if options.cache:
            with self._lock:
                if key in self._cache:
                    self._cache.move_to_end(key)
                    held = self._cache[key]
                    return replace(held, hits=list(held.hits), stats=replace(held.stats, cache_hit=True))
        found = self._run(own, query, options, False)
        if options.cache and self.config.query_cache_capacity > 0:
            with self._lock:
                if self._snapshot is own:
                    self._cache[key] = replace(found, hits=list(found.hits))
                    while len(self._cache) > self.config.query_cache_capacity:
                        self._cache.popitem(last=False)
        return found

    def search_exhaustive(self, query: Query, options: SearchOptions | None = None) -> SearchResult:
        """Looks at every live document, without the cache."""
        return self._run(self.snapshot(), query, (options or SearchOptions()).validated(), True)

    def _run(self, own: Snapshot, query: Query, options: SearchOptions, exhaustive: bool) -> SearchResult:
        index, seen = own.index(), (Observation(), Observation())
        hits = planner.ranked(index, query, options, exhaustive, seen=seen).orderBy(*planner.order()).limit(options.limit).collect()
        texts = {}
        for begin in range(0, len(hits), 1000):  # the hits are at most ``limit``
            some = [h.rowid for h in hits[begin : begin + 1000]]
            texts |= {r.rowid: tuple(r.fields) for r in index.docs.where(F.col("rowid").isin(some)).select("rowid", "fields").collect()}
        stats = SearchStats(index.segments, seen[0].get.get("n", 0), seen[1].get.get("n", 0))
        return SearchResult([SearchHit(h.rowid, h.score, texts[h.rowid]) for h in hits], stats, own.manifest.generation)


class Transaction:
    """Buffered operations; nothing is visible before commit. Of several operations on a row the last counts."""

    def __init__(self, database: Database):
        self._database = database
        self._ops: list[tuple[int, str, list[str] | None]] | None = []

    def _open(self) -> list[tuple[int, str, list[str] | None]]:
        if self._ops is None:
            raise TransactionClosed
        return self._ops

    def upsert(self, rowid: int, fields: Iterable[str]) -> None:
        self._open().append((rowid, "upsert", list(fields)))

    def upsert_text(self, rowid: int, text: str) -> None:
        self.upsert(rowid, [text])

    def delete(self, rowid: int) -> None:
        self._open().append((rowid, "delete", None))

    def rollback(self) -> None:
        self._open()
        self._ops = None

    def commit(self) -> int:
        """The new generation; without operations the current one, and nothing is written."""
        ops = self._open()
        for _, op, fields in ops:
            if op == "upsert" and not fields:
                raise InvalidInput("an upsert needs a field")
            if op == "upsert" and len(fields) > MAX_FIELDS:
                raise InvalidInput(f"an upsert takes no more than {MAX_FIELDS} fields")
            if op == "upsert" and not all(isinstance(f, str) for f in fields):
                raise InvalidInput("fields must be strings")
        self._ops = None
        if not ops:
            return self._database.generation
        last = {o[0]: o for o in ops}
        rows = self._database.spark.createDataFrame(sorted(last.values(), key=lambda o: o[0]), OPS)
        return self._database.commit_ops(rows)
