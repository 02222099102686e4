"""Ingestion: content ids, chunks, first-wins dedup, incremental anti-joins, changed files, profiles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.code import shipped

SEPARATORS = ["\n\n", "\n", " ", ""]
#: Bytes of text that a Python worker turns into chunks at a time; a longer text is taken alone.
PART_BYTES = 1 << 20


def content_id(text: str | F.Column) -> F.Column:
    """SHA-256 of the text in hexadecimal."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def chunk_windows(docs: DataFrame, size: int = 1000, step: int = 600, text_col: str = "text") -> DataFrame:
    """docs without the text, with chunk_index (from 0), total_chunks and text: windows of `size` characters every `step`.

    The last window is the first that reaches the end, so short texts have one; null and empty texts have none.
    """
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - size) / step).cast("int") + 1)
    some = docs.filter(F.length(text_col) > 0).withColumn("total_chunks", n.cast("int"))
    each = some.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    return each.withColumn("text", F.substring(text_col, F.col("chunk_index") * step + 1, F.lit(size)))


def split_text(text: str, size: int = 1000, overlap: int = 400, separators: list[str] | None = None) -> list[str]:
    """Chunks of at most `size` characters, cut at paragraphs, else lines, else words, else anywhere.

    The text is taken apart at the first separator that occurs, and pieces over the size at the next one. Pieces are packed
    in order; a full chunk is followed by one that begins with its last pieces, `overlap` characters of them at most and so
    many as leave room for the next piece. Edges are stripped; empty chunks are dropped.
    """
    if overlap >= size:
        raise ValueError("overlap must be under the size")

    def pieces(t: str, seps: list[str]) -> Iterator[tuple[str, str]]:
        """(piece, what stands before it), one at a time."""
        at = next(i for i, s in enumerate(seps) if s == "" or s in t)
        sep = seps[at]
        if sep == "":
            yield from ((c, "") for c in t)
            return
        start, end = 0, 0
        while end >= 0:
            end = t.find(sep, start)
            p = t[start:end] if end >= 0 else t[start:]
            lead = sep if start else ""
            if len(p) <= size:
                yield p, lead
            else:
                for inner, before in pieces(p, seps[at + 1:]):
                    yield inner, before if lead is None else lead
                    lead = None
            start = end + len(sep)

    out: list[str] = []
    held: deque[tuple[str, str]] = deque()
    length = 0
    for piece, lead in pieces(text, separators or SEPARATORS):
        extra = len(piece) + (len(lead) if held else 0)
        if held and length + extra > size:
            out.append("".join(p if i == 0 else s + p for i, (p, s) in enumerate(held)))
            while held and (length > overlap or length + len(lead) + len(piece) > size):
                gone = held.popleft()
                length -= len(gone[0]) + (len(held[0][1]) if held else 0)
            extra = len(piece) + (len(lead) if held else 0)
        held.append((piece, lead))
        length += extra
    if held:
        out.append("".join(p if i == 0 else s + p for i, (p, s) in enumerate(held)))
    return [c for c in (x.strip() for x in out) if c]


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices of at most `size` bytes of a text column, one row at least: Spark's batches grow with their texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, to - at)
        at = to


def chunk_recursive(docs: DataFrame, size: int = 1000, overlap: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, total_chunks, chunk_id, text) by split_text(), Arrow batch by batch, in parts of PART_BYTES."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts(whole, 1)):
            found = [split_text(t or "", size, overlap) for t in b.column(1).to_pylist()]
            take = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(take), pa.array([i for x in found for i in range(len(x))], pa.int32()),
                pa.array([len(x) for x in found for _ in x], pa.int32()), pa.array([c for x in found for c in x], pa.string())], names=[id_col, "chunk_index", "total_chunks", "text"])

    out = shipped(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, total_chunks int, text string")
    return out.select(id_col, "chunk_index", "total_chunks", content_id("text").alias("chunk_id"), "text")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ranked before the shuffle too, so a key that many rows hold doesn't meet in one task."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def new_only(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored."""
    return rows.join(stored.select(key), key, "left_anti")


def duplicate_report(rows: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """One row: rows, kinds, duplicates within, and how many kinds are new or stored already."""
    kinds = rows.groupBy(key).agg(F.count("*").alias("n"))
    known = stored.select(key).distinct().withColumn("known", F.lit(True)) if stored is not None else None
    kinds = kinds.join(known, key, "left") if known is not None else kinds.withColumn("known", F.lit(None).cast("boolean"))
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("known").alias("stored"), (F.count("*") - F.count("known")).alias("added"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, mtime, size) that the manifest doesn't have, or has with another time or size."""
    m = manifest.select(F.col("path"), F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    joined = files.join(m, "path", "left")
    return joined.filter(F.col("_known").isNull() | ~F.col("mtime").eqNullSafe(F.col("_m")) | ~F.col("size").eqNullSafe(F.col("_s"))).drop("_m", "_s", "_known")


def file_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, mtime, size, change): how files (path, mtime, size) differ from what is known of them (the same, the last version of each): 'new', 'changed' or 'gone'.

    A gone file has the time and size that it had. One full join on the path; files that are as they were aren't in it.
    """
    k = known.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    both = files.select("path", "mtime", "size", F.lit(True).alias("_here")).join(k, F.col("path") == F.col("_path"), "full")
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_here").isNull(), "gone").when(~same, "changed")
    gone = F.col("_here").isNull()
    pick = lambda c: F.when(gone, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(pick("path"), pick("mtime"), pick("size"), change.alias("change")).filter("change is not null")


def source_profile(chunks: DataFrame, source: str = "source") -> DataFrame:
    """(source, chunks, documents): rows a source."""
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def source_sets(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, expected, found): base names that either side has, and which."""
    name = lambda df: df.select(F.element_at(F.split("source", "/"), -1).alias("name")).distinct()
    a, b = name(expected).withColumn("expected", F.lit(True)), name(found).withColumn("found", F.lit(True))
    return a.join(b, "name", "full").select("name", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("found", F.lit(False)).alias("found"))
