"""The vector store: one Parquet table of chunks by collection and bucket of their ids, beside tables of their places, of their sources' versions and of metadata."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import first_wins, new_only
from tessera.operators.search import top_k

CHUNKS = "collection string, doc_id string, source string, source_type string, chunk_index int, total_chunks int, text string, vector array<float>, extra map<string,string>"
OCCURRENCES = "collection string, doc_id string, source string, chunk_index int, total_chunks int, version long"
VERSIONS = "collection string, source string, version long, state string, mtime double, size long"
FAILURES = "collection string, source string, version long, error string"
METADATA = "collection string, embedding_model string, embedding_dimension int, chunk_size int, chunk_overlap int, created_at string, total_documents long"


class ChunkStore:
    """Chunks with vectors. Ids are hashes of the text, so a chunk is stored once a collection; where it stands, in one source or several, is a table of its own, and so is metadata.

    Nothing is ever rewritten. A source put in by put() has versions: readers see the places of its last one, and none if that
    says that the source is gone; chunks without a place aren't seen. Chunks lie in BUCKETS by their ids, so that what an increment
    may hold already is looked for in the buckets that it touches.
    """

    #: Buckets of a collection, and rows of an increment whose ids are broadcast to the stored rows (64 bytes each, about).
    BUCKETS, SMALL = 16, 400_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _places(self, collection: str | None) -> DataFrame:
        """The places that readers see."""
        at = self._read("occurrences", OCCURRENCES)
        at = at if collection is None else at.filter(F.col("collection") == collection)
        if not self._exists("versions"):
            return at.drop("version")
        last = self.versions(collection).select(F.col("collection").alias("_c"), F.col("source").alias("_s"), F.col("version").alias("_v"), "state")
        met = at.join(last, (at["collection"] == F.col("_c")) & (at["source"] == F.col("_s")), "left")
        return met.filter(F.col("_v").isNull() | ((F.col("version") == F.col("_v")) & (F.col("state") == "live"))).select(*[c for c in at.columns if c != "version"]).distinct()

    def versions(self, collection: str | None = None) -> DataFrame:
        """(collection, source, version, state, mtime, size): the last version of each source, live or gone."""
        at = self._read("versions", VERSIONS)
        at = at if collection is None else at.filter(F.col("collection") == collection)
        return at.groupBy("collection", "source").agg(F.max(F.struct("version", "state", "mtime", "size")).alias("x")).select("collection", "source", "x.*")

    def failures(self) -> DataFrame:
        """(collection, source, version, error): files that couldn't be read; the version before them is still seen."""
        return self._read("failures", FAILURES)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def chunks(self, collection: str | None = None) -> DataFrame:
        """All chunks, or those of a collection (a partition filter), that have a place."""
        df = self._read("chunks", CHUNKS).drop("bucket")
        df = df if collection is None else df.filter(F.col("collection") == collection)
        return df.join(self._places(collection), ["collection", "doc_id"], "left_semi") if self._exists("versions") else df

    def metadata(self) -> DataFrame:
        return self._read("metadata", METADATA)

    def collections(self) -> DataFrame:
        """(collection, chunks, sources)."""
        n = self.chunks().groupBy("collection").agg(F.count("*").alias("chunks"))
        return n.join(self._places(None).groupBy("collection").agg(F.countDistinct("source").alias("sources")), "collection", "left")

    def add(self, chunks: DataFrame, collection: str, model: str = "", dimension: int = 0, size: int = 1000, overlap: int = 400) -> dict:
        """Appends chunks that the collection doesn't hold yet; returns counts of new, duplicate and stored ones."""
        own = self._shaped(chunks, collection)
        places = own.select("collection", "doc_id", "source", "chunk_index", "total_chunks").distinct()
        given = own.count()
        unique, added = self._append_new(own, collection)
        key = ["doc_id", "source", "chunk_index"]
        known = self._read("occurrences", OCCURRENCES).filter(F.col("collection") == collection).select(*key)
        on = [places[c].eqNullSafe(known[c]) for c in key]
        places.join(known, on, "left_anti").withColumn("version", F.lit(None).cast("long")).write.mode("append").partitionBy("collection").parquet(f"{self.path}/occurrences")
        self._describe(collection, model, dimension, size, overlap, added)
        return {"given": given, "duplicates": given - unique, "stored": unique - added, "added": added}

    def _shaped(self, chunks: DataFrame, collection: str) -> DataFrame:
        own = chunks.withColumn("collection", F.lit(collection))
        fields = self.spark.createDataFrame([], CHUNKS).schema.fields
        for f in fields:
            if f.name not in own.columns:
                own = own.withColumn(f.name, F.lit(None).cast(f.dataType))
        return own.select(*[f.name for f in fields])

    def stored_ids(self, ids: DataFrame, collection: str, small: bool) -> DataFrame:
        """Those of ids (doc_id, bucket) that the collection holds. A small increment goes to the stored rows, of which nothing but the id is read and none is shuffled."""
        held = self._read("chunks", CHUNKS + ", bucket int").filter(F.col("collection") == collection).select("doc_id", "bucket")
        if small:
            touched = [r.bucket for r in ids.select("bucket").distinct().collect()]
            return held.filter(F.col("bucket").isin(touched)).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("doc_id")
        return held.join(ids, ["doc_id", "bucket"], "left_semi").select("doc_id")

    def _append_new(self, own: DataFrame, collection: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, int]:
        """Appends the chunks whose ids are new, the first row of each; returns the number of ids and of new ones, which is observed while they are written."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.BUCKETS)).cast("int")
        kinds = first_wins(own, ["doc_id"], ["source", "chunk_index"]).withColumn("bucket", bucket).persist()
        try:
            unique = kinds.count()
            known = self.stored_ids(kinds.select("doc_id", "bucket"), collection, unique <= self.SMALL)
            fresh = new_only(kinds, F.broadcast(known) if unique <= self.SMALL else known, "doc_id")
            if embed is not None:
                fresh = embed(fresh.drop("vector")).select(*kinds.columns)
            seen = Observation()
            fresh.observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("collection", "bucket").parquet(f"{self.path}/chunks")
            return unique, seen.get["n"]
        finally:
            kinds.unpersist()

    def _describe(self, collection: str, model: str, dimension: int, size: int, overlap: int, added: int) -> None:
        if self.metadata().filter(F.col("collection") == collection).isEmpty():
            row = [(collection, model, dimension, size, overlap, datetime.now(timezone.utc).isoformat(), added)]
            self.spark.createDataFrame(row, METADATA).write.mode("append").parquet(f"{self.path}/metadata")

    def put(self, changes: DataFrame, chunks: DataFrame, collection: str, embed: Callable[[DataFrame], DataFrame] | None = None, model: str = "", dimension: int = 0, size: int = 1000, overlap: int = 400) -> dict:
        """Puts in versions of sources: changes (source, version, state 'live' or 'gone', mtime, size) and the chunks of the live ones (source, version, ...).

        The versions are written last: until then readers see what they saw before, and a call that was cut short can be made
        again (places of a version that are there aren't written twice). Only new chunks go through embed().
        """
        own = self._shaped(chunks, collection)
        places = chunks.select(F.lit(collection).alias("collection"), "doc_id", "source", "chunk_index", "total_chunks", F.col("version").cast("long").alias("version")).distinct()
        key = ["source", "version", "chunk_index"]
        known = self._read("occurrences", OCCURRENCES).filter((F.col("collection") == collection) & F.col("version").isNotNull()).select(*key)
        places.join(known, key, "left_anti").write.mode("append").partitionBy("collection").parquet(f"{self.path}/occurrences")
        unique, added = self._append_new(own, collection, embed)
        self._describe(collection, model, dimension, size, overlap, added)
        seen = Observation()
        rows = changes.select(F.lit(collection).alias("collection"), "source", F.col("version").cast("long").alias("version"), "state", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"))
        rows.observe(seen, F.count("*").alias("n"), F.count_if(F.col("state") == "gone").alias("gone")).write.mode("append").partitionBy("collection").parquet(f"{self.path}/versions")
        return {"versions": seen.get["n"], "gone": seen.get["gone"], "chunks": unique, "added": added}

    def fail(self, failed: DataFrame, collection: str) -> None:
        """Notes files (source, version, error) that couldn't be read."""
        failed.select(F.lit(collection).alias("collection"), "source", F.col("version").cast("long").alias("version"), "error").write.mode("append").parquet(f"{self.path}/failures")

    def occurrences(self, collection: str | None = None) -> DataFrame:
        """(collection, doc_id, source, chunk_index, total_chunks, text): each place of each chunk, so that no source has gaps."""
        at = self._places(collection)
        return at.join(self.chunks(collection).select("collection", "doc_id", "text"), ["collection", "doc_id"])

    def embedding_model(self, collection: str | None = None) -> str | None:
        """The model that the collection (or the first that names one) was embedded with."""
        m = self.metadata().filter("embedding_model <> ''")
        m = m if collection is None else m.filter(F.col("collection") == collection)
        row = m.orderBy("collection").limit(1).collect()
        return row[0].embedding_model if row else None

    def search(self, queries: DataFrame, k: int = 4, kind: str = "cosine_distance", collections: list[str] | None = None) -> DataFrame:
        """The k nearest chunks of each query, of each collection if several are named, joined to their text.

        A name without a chunk finds nothing; missing() tells which. None of several having any is a LookupError.
        """
        if collections and len(self.missing(collections)) == len(set(collections)):
            raise LookupError(f"no chunks in any of the collections {sorted(set(collections))}")
        df = self.chunks() if collections is None else self.chunks().filter(F.col("collection").isin(collections))
        keyed = df.withColumn("id", F.xxhash64("collection", "doc_id"))
        hits = top_k(keyed.select("id", "vector", "collection"), queries, k, kind, collection="collection" if collections and len(collections) > 1 else None, exclude_self=False)
        return hits.drop("collection").join(keyed.drop("vector"), "id")

    def missing(self, collections: list[str]) -> list[str]:
        """Those of the collections that hold nothing."""
        held = {r.collection for r in self.chunks().filter(F.col("collection").isin(collections)).select("collection").distinct().collect()}
        return sorted(set(collections) - held)

    def placed(self, hits: DataFrame) -> DataFrame:
        """hits once for each place of their chunk: a chunk that several sources share is expanded in each of them."""
        at = self._places(None)
        return hits.drop("source", "chunk_index", "total_chunks").join(at, ["collection", "doc_id"])

    def chunk(self, source: str, index: int, collection: str | None = None) -> DataFrame:
        """One chunk by its place."""
        return self.occurrences(collection).filter((F.col("source") == source) & (F.col("chunk_index") == index)).limit(1)

    def describe(self) -> DataFrame:
        """(collection, chunks, sources, embedding_model, embedding_dimension)."""
        m = self.metadata().select("collection", "embedding_model", "embedding_dimension")
        return self.collections().join(m, "collection", "left")

    def problems(self, dimension: int | None = None) -> list[str]:
        """What stands in the way of answering from this store."""
        out = []
        if self.chunks().limit(1).count() == 0:
            out.append("the store is empty")
        if dimension is not None and self.chunks().filter(F.size("vector") != dimension).limit(1).count():
            out.append(f"vectors of another length than {dimension}")
        return out


class HostedStore:
    """The place of a hosted vector index: what an implementation has to offer. Using this one says what is missing."""

    #: Kinds that need a service, which isn't here.
    needs = "a hosted index: enter a class with ChunkStore's methods (chunks, metadata, add, search, occurrences) in STORES['hosted']"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str):
        raise NotImplementedError(f"{name} needs {type(self).needs}")

    def problems(self, dimension: int | None = None) -> list[str]:
        return [f"not available: it needs {self.needs}"]


STORES = {"parquet": ChunkStore, "hosted": HostedStore}


def open_store(kind: str, spark: SparkSession, path: str) -> ChunkStore | HostedStore:
    """A store by the name of its layout."""
    if kind not in STORES:
        raise ValueError(f"unknown store: {kind}; known: {sorted(STORES)}")
    return STORES[kind](spark, path)
