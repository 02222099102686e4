"""Incremental ingestion with Structured Streaming: new, changed and gone files to chunks to the store, and the first of each id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.ingest import chunk_recursive, file_changes
from tessera.sources.models import Embedder, embed
from tessera.sources.readers import files, kind_of, parsed_content
from tessera.sources.saved import saved
from tessera.sources.store import ChunkStore

CHANGES = "path string, mtime double, size long, change string, version long"


def ingest_texts(spark: SparkSession, folder: str, store: ChunkStore, collection: str, model: Embedder, checkpoint: str, size: int = 1000, overlap: int = 400) -> StreamingQuery:
    """Text files that came since the last run are chunked, embedded and added; it stops when all are done.

    A batch that is run again adds nothing twice: ids are hashes of the text, and stored ids are left out. A file
    rewritten under its old name isn't read again; changed files are found by operators.ingest.changed_files().
    """
    stream = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))

    def add(batch: DataFrame, _: int) -> None:
        chunks = chunk_recursive(batch, size, overlap, id_col="source")
        rows = chunks.select(F.col("chunk_id").alias("doc_id"), "source", F.lit("file").alias("source_type"), "chunk_index", "total_chunks", "text")
        store.add(embed(rows, model), collection, type(model).__name__, model.dimension, size, overlap)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_changes(spark: SparkSession, folder: str, log: str) -> int:
    """Compares a folder with the log of its changes, appends what is new, changed or gone as one version, and returns how many that are."""
    try:
        told = spark.read.schema(CHANGES).parquet(log)
    except AnalysisException:
        told = spark.createDataFrame([], CHANGES)
    last = told.groupBy("path").agg(F.max(F.struct("version", "mtime", "size", "change")).alias("x")).select("path", "x.*").filter("change <> 'gone'")
    version = (told.agg(F.max("version")).first()[0] or 0) + 1
    found = saved(file_changes(files(spark, folder), last).withColumn("version", F.lit(version).cast("long")))
    n = found.count()
    if n:
        found.coalesce(max(1, min(64, n // 100_000))).write.mode("append").parquet(log)
    return n


def ingest_versions(spark: SparkSession, folder: str, log: str, store: ChunkStore, collection: str, model: Embedder, checkpoint: str, size: int = 1000, overlap: int = 400, parsers: dict[str, Callable[[bytes], str]] | None = None, per_batch: int = 10_000) -> StreamingQuery:
    """What log_changes() found of a folder since the last run goes to the store, and the query stops.

    New and changed files are read (by kind: text, pdf, and media if `parsers` has a reader for it), chunked and put in as versions of their
    sources; gone ones get a version that says so. Of several versions of a file in a batch only the last counts. A file
    that can't be read is noted as a failure, and the version before it stays. A batch that is run again, after a crash too,
    writes nothing twice. Unchanged files are never read again. A batch has the changes of at most per_batch log files, whose
    paths come to the driver to be read.
    """
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max(1, per_batch // 1000)).parquet(log)

    def apply(batch: DataFrame, _: int) -> None:
        last = saved(batch.groupBy("path").agg(F.max(F.struct("version", "mtime", "size", "change")).alias("x")).select("path", "x.*"))
        paths = [r.path for r in last.filter("change <> 'gone'").select("path").collect()]
        read = saved(parsed_content(spark, paths, parsers).join(last.select("path", "version"), "path"))
        failed = read.filter("error is not null").select(F.col("path").alias("source"), "version", "error")
        if not failed.isEmpty():
            store.fail(failed, collection)
        here = read.filter("error is null")
        rows = chunk_recursive(here.select("path", "text"), size, overlap, id_col="path").join(here.select("path", "version"), "path")
        chunks = rows.select(F.col("chunk_id").alias("doc_id"), F.col("path").alias("source"), kind_of(F.col("path")).alias("source_type"), "chunk_index", "total_chunks", "text", "version")
        gone = F.col("change") == "gone"
        done = last.join(failed.select(F.col("source").alias("path")), "path", "left_anti")
        changes = done.select(F.col("path").alias("source"), "version", F.when(gone, "gone").otherwise("live").alias("state"), "mtime", "size")
        store.put(changes, chunks, collection, lambda df: embed(df, model), type(model).__name__, model.dimension, size, overlap)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _First(StatefulProcessor):
    """Keeps, for each id, only that it was seen; of the rows that come together the first in order passes."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:  # all are read, one frame at a time
            own = frame if first is None else pd.concat([first, frame])
            first = own.sort_values(self.order, kind="stable").head(1)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_wins_stream(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each id of a stream: state by id (a flag and the key in RocksDB, about 100 bytes an id) in place of a look at all that is stored.

    Of rows that come in one batch the first by `order` passes, as operators.ingest.first_wins() has it. The state store has to be RocksDB
    (use_rocksdb()). It has no end: an id is known for as long as the checkpoint is kept.
    """
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_First(order), outputStructType=rows.schema, outputMode="append", timeMode="none")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
