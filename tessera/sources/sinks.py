"""Sinks: results, chunks, answers, questions and manifests written in the forms that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import preview
from tessera.functions.vectors import LOWER_IS_BETTER, similarity
from tessera.sources.readers import versions
from tessera.sources.saved import remove


def flat_results(results: DataFrame) -> DataFrame:
    """Results with lists (sources, retrieved) as flat columns, for CSV: sources joined, and the first chunk's scores."""
    first = F.get("retrieved", 0)
    return results.select("query_id", F.concat_ws(";", "sources").alias("sources"), "found_rank", "success", first["id"].alias("top_id"), first["score"].alias("top_score"))


def exploded_chunks(results: DataFrame) -> DataFrame:
    """One row for each retrieved chunk of each result."""
    return results.select("query_id", "success", F.explode("retrieved").alias("r")).select("query_id", "success", "r.*")


def answer_json(answers: DataFrame, kind: str, length: int = 0) -> DataFrame:
    """(query_id, json): question, answer, numbered references with a similarity that grows with nearness, and counts."""
    one = lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), (x["chunk_index"] + 1).alias("chunk"), (similarity(x["score"]) if LOWER_IS_BETTER[kind] else x["score"]).alias("similarity"), (preview(x["text"], length) if length else x["text"]).alias("text"))
    references = F.transform("references", one)
    return answers.select("query_id", F.to_json(F.struct(F.col("question").alias("query"), "answer", references.alias("references"), F.struct(F.size("references").alias("total_references"), F.lit(kind).alias("score_kind")).alias("metadata"))).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def error_json(failed: DataFrame) -> DataFrame:
    """(query_id, json) of (query_id, question, error): what is said instead of an answer."""
    return failed.select("query_id", F.to_json(F.struct("error", F.coalesce("question", F.lit("unknown")).alias("query"))).alias("json"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Writes the next version of a manifest beside the last one, which goes once the new one is whole.

    readers.manifest() takes the last whole version, so a crash leaves the old one, and a manifest can be made from itself.
    """
    spark, before = manifest.sparkSession, versions(manifest.sparkSession, path)
    manifest.write.mode("overwrite").parquet(f"{path}/v{max(before, default=0) + 1}")
    for v in before:
        remove(spark, f"{path}/v{v}")


def write_transcripts(texts: DataFrame, path: str) -> None:
    """Appends texts (path, mtime, size, text) to the transcripts that readers.through_cache() reads through."""
    texts.select("path", "mtime", "size", "text").write.mode("append").parquet(path)
