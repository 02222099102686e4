"""Readers: texts, binary files, pages, manifests and question files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.misc import kept_metadata
from tessera.functions.text import is_url
from tessera.sources import pdf
from tessera.sources.code import shipped

#: File names that are read, by what they end in.
EXTENSIONS = ["mp3", "wav", "txt", "pdf", "mp4", "avi", "mov", "mkv", "webm", "flv", "m4v", "3gp"]
QUESTIONS = "question string, passage string, chunk_id string, sources array<string>, generated_with string, chunk_index int, total_chunks int, file string"
TRANSCRIPTS = "path string, mtime double, size long, text string"
MANIFEST = "path string, mtime double, size long, url string, processed_time double"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size): the files of a folder, not of folders in it, that can be read. Contents are not read."""
    found = spark.read.format("binaryFile").load(folder)
    found = found.filter(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))
    return found.select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def parsed_files(spark: SparkSession, folder: str, parse: Callable[[str, bytes], str], pattern: str = "*") -> DataFrame:
    """(path, text, error): binary files through a parser (PDF text, speech); a file that fails has its error, not a lost row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append((path, parse(path, content), None))
                except Exception as e:  # noqa: BLE001 - a parser may raise anything; it's reported in its row
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["path", "text", "error"])

    return shipped(raw).mapInArrow(run, "path string, text string, error string")


def parsed_content(spark: SparkSession, paths: list[str], parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) of files by name, each read by its kind: text (UTF-8), pdf, and what `parsers` (kind: reader of bytes) adds or replaces.

    A kind without a parser, and a file whose parser fails, has an error in its row. No paths: no rows.
    """
    if not paths:
        return spark.createDataFrame([], "path string, text string, error string")
    known: dict[str, Callable[[bytes], str]] = {"text": lambda x: x.decode("utf-8", errors="replace"), "pdf": lambda x: "\n".join(pdf.read(x)[0])} | (parsers or {})
    raw = spark.read.format("binaryFile").load(paths).select("path", kind_of(F.col("path")).alias("kind"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, kind, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if kind not in known:
                        raise ValueError(f"no parser for {kind}")
                    out.append((path, known[kind](content), None))
                except Exception as e:  # noqa: BLE001 - a parser may raise anything; it's reported in its row
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["path", "text", "error"])

    return shipped(raw).mapInArrow(run, "path string, text string, error string")


def pdf_texts(spark: SparkSession, folder: str, parse: Callable[[bytes], tuple[list[str], dict[str, str]]] = pdf.read) -> DataFrame:
    """(path, text, extra, error): PDF files, their pages joined by a line break, with the allowed entries of their metadata."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path", "content")
    out = _pages(raw, parse).select("path", F.array_join("pages", "\n").alias("text"), kept_metadata(F.col("about")).alias("extra"), "error")
    return out


def _pages(raw: DataFrame, parse: Callable[[bytes], tuple[list[str], dict[str, str]]]) -> DataFrame:
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    pages, about = parse(content)
                    out.append((path, len(content), content[:5], list(pages), list(about.items()), None))
                except Exception as e:  # noqa: BLE001 - a parser may raise anything; it's reported in its row
                    out.append((path, len(content), content[:5], None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), kind, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["path", "size", "head", "pages", "about", "error"])

    return shipped(raw).mapInArrow(run, "path string, size long, head binary, pages array<string>, about map<string,string>, error string")


def pdf_health(spark: SparkSession, folder: str, parse: Callable[[bytes], tuple[list[str], dict[str, str]]] | None = pdf.read) -> DataFrame:
    """(path, size, pages, valid, message): PDF files by their pages, else by size and magic number.

    A file is sound if it has pages and ten letters of text on the first, or, where the parser finds less or fails, if it has
    1000 bytes and begins as PDF files do.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path", "content")
    if parse is None:
        none = [F.lit(None).cast("array<string>").alias("pages"), F.lit("no parser").alias("error")]
        read = raw.select("path", F.length("content").cast("long").alias("size"), F.substring("content", 1, 5).alias("head"), *none)
    else:
        read = _pages(raw, parse)
    n, first = F.coalesce(F.size("pages"), F.lit(0)), F.length(F.trim(F.get("pages", 0)))
    fine, whole, begins = (n > 0) & (first >= 10), F.col("size") >= 1000, F.col("head") == F.lit("%PDF-").cast("binary")
    why = F.when(fine, F.concat(F.lit("OK ("), n, F.lit(" pages)"))).when(~whole, F.concat(F.lit("too small ("), "size", F.lit(" bytes)"))).when(~begins, F.lit("not a PDF header")).otherwise(F.concat(F.lit("size and header OK ("), "size", F.lit(" bytes)")))
    return read.select("path", "size", F.when(F.col("pages").isNotNull(), n).alias("pages"), F.coalesce(fine, F.lit(False)).alias("f"), (whole & begins).alias("b"), why.alias("message")).select("path", "size", "pages", (F.col("f") | F.col("b")).alias("valid"), "message")


def health_counts(health: DataFrame) -> DataFrame:
    """One row: sound and corrupt files."""
    return health.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("corrupt"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The texts taken from files so far, by path, time and size; empty where there are none yet."""
    try:
        return spark.read.schema(TRANSCRIPTS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], TRANSCRIPTS)


def through_cache(found: DataFrame, known: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all texts, new ones) of files (path, mtime, size): a transcript of the same path, time and size is used again.

    extract gives (path, text) of the files that have none, which are those that are new or changed.
    """
    key = ["path", "mtime", "size"]
    held = found.join(known.dropDuplicates(key), key).select(*key, "text")
    missing = found.join(known.select(*key), key, "left_anti")
    fresh = missing.join(extract(missing), "path").select(*key, "text")
    return held.unionByName(fresh), fresh


def kind_of(path: F.Column) -> F.Column:
    """How an input is read: url, text, pdf, media or unknown."""
    low = F.lower(path)
    media = "|".join(x for x in EXTENSIONS if x not in ("txt", "pdf"))
    return F.when(is_url(path), "url").when(low.rlike(r"\.txt$"), "text").when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(rf"\.({media})$"), "media").otherwise("unknown")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records of a JSON array file."""
    return spark.read.schema(QUESTIONS).json(path, multiLine=True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table that is written version by version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and whole(n))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What was processed so far, by the last whole version; empty where there is no manifest yet."""
    found = versions(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], MANIFEST)
