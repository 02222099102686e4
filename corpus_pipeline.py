"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, BPE. Counted as part of tessera.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, line_dedup, mixing, near_copies
from tessera.llm.common import fold, folder, table
from tessera.sources.saved import remove

#: A document with less evidence than this (see langid.Model.label) isn't text of learned languages, one or several.
LEAST_EVIDENCE = 0.75


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages: not 'und', evidence LEAST_EVIDENCE at least. Learns as op4 does, from documents not held out."""
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    own = {c: f"_tz_own_{c}" for c in docs.columns if c in ("lang_pred", "score", "evidence")}  # columns of these names stay as they are
    found = langid.identify(docs.withColumnsRenamed(own), model, spans=False, evidence=True)
    sure = found.filter((F.col("lang_pred") != "und") & (F.col("evidence") >= LEAST_EVIDENCE)).drop("lang_pred", "score", "evidence")
    return sure.withColumnsRenamed({v: k for k, v in own.items()}).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share, but in the one of the largest id. n_chars follows the text."""
    names = docs.columns
    own = {c: f"_tz_own_{c}" for c in names if c in ("n_lines", "n_dropped")}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles alike), the one of the smallest id."""
    return near_copies.keep_one(docs).select(*(f"`{c}`" for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers

    out = bpe.bpe_round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), digests=True, keep_text=False)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: SQL has no n-gram Viterbi, no XXH64 and no BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read as the next one's input.

    A stage's table is whole once it is written, so the one before it is removed then; the last one stays.
    """
    at = f"{folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            remove(spark, before)
        before = out
    return docs
