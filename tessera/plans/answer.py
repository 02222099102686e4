"""Question answering over many questions in one plan: search, expand, answer, validate, attribute."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import LOWER_IS_BETTER
from tessera.operators import context as C
from tessera.operators.search import parse_sweep, rerank
from tessera.sources.models import Embedder, Generator, Reranker, embed, generate, score_pairs
from tessera.sources.store import ChunkStore

CONFIDENT, COVERED, CONTRIBUTES = 0.6, 0.7, 0.08
UNKNOWN = "I don't know"


def validated(answers: DataFrame, reply: str | None = None) -> DataFrame:
    """answers (answer, context) with confidence, coverage, valid and final_answer.

    reply: a column with a fact-checker's reply, if there is one; no reply, as after an error, does not stand against an answer.
    """
    out = answers.withColumn("confidence", T.confidence(F.col("answer"))).withColumn("coverage", T.coverage(T.coverage_phrases(F.col("answer")), F.col("context")))
    sound = (F.col("confidence") >= CONFIDENT) & (F.col("coverage") >= COVERED)
    if reply is not None:
        sound = sound & (F.col(reply).isNull() | T.verdict(F.col(reply))["valid"])
    out = out.withColumn("valid", sound)
    return out.withColumn("final_answer", F.when(F.col("valid"), F.col("answer")).otherwise(F.lit(UNKNOWN)))


def attributed(pairs: DataFrame) -> DataFrame:
    """pairs (answer, text) with contribution and contributes; the answer's side is worked out once a row of pairs."""
    answer, doc = F.col("answer"), F.col("text")
    out = pairs.withColumn("_p", T.attribution_phrases(answer)).withColumn("_w", T.significant_words(answer)).withColumn("_e", T.entities(answer))
    out = out.withColumn("contribution", T.contribution(F.col("_p"), F.col("_w"), F.col("_e"), doc, T.significant_words(doc), T.entities(doc))).drop("_p", "_w", "_e")
    known = ~F.trim(answer).isin("", UNKNOWN)
    return out.withColumn("contributes", known & (F.col("contribution") >= CONTRIBUTES))


def asked(questions: DataFrame) -> DataFrame:
    """The questions that aren't blank."""
    return questions.filter(F.trim("question") != "")


def answer(store: ChunkStore, questions: DataFrame, embedder: Embedder, generator: Generator, k: int = 4, window: int = 2, kind: str = "cosine_distance", collections: list[str] | None = None, reranker: Reranker | None = None, kk: int | None = None, on_error: float | str = "keep_order", every_source: bool = False) -> DataFrame:
    """(query_id, question, context, answer, confidence, coverage, valid, final_answer, references) of (query_id, question).

    Blank questions are left out. With a reranker the k hits are reranked, and kk of them kept (all, if not given); on_error
    is models.score_pairs()'s. Ranges keep the best score of their hits, and contexts are put together best first. A hit is
    expanded in the source that it was first found in or, with every_source, in each source that holds its text.
    """
    questions = asked(questions)
    vectors = embed(questions, embedder, "question").select("query_id", "vector")
    hits, lower = store.search(vectors, k, kind, collections), LOWER_IS_BETTER[kind]
    if reranker is not None:
        scored = score_pairs(hits.join(questions.select("query_id", "question"), "query_id"), reranker, on_error=on_error)
        hits = rerank(scored, F.col("rerank_score"), kk).withColumn("rank", F.col("new_rank") + 1).withColumn("score", F.col("rerank_score"))
        hits, lower = hits.drop("question", "rerank_score", "error", "original_rank", "new_rank", "direction"), False
    by = ["query_id", "collection", "source"]
    ranges = C.merge_ranges(C.neighbours(store.placed(hits) if every_source else hits, window), by, lower)
    around = C.expand(ranges, store.occurrences(), ["collection", "source"], ["query_id"])
    order = F.col("score") if lower else -F.col("score")
    parts = around.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("s"), "source", "start", "text"))).alias("parts"))
    contexts = questions.join(parts, "query_id", "left").withColumn("context", F.coalesce(F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n"), F.lit(""))).drop("parts")
    answers = validated(generate(contexts, generator))
    pairs = attributed(hits.select("query_id", "rank", "id", "score", "chunk_index", "source", "text").join(answers.select("query_id", F.col("final_answer").alias("answer")), "query_id"))
    references = pairs.filter("contributes").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "chunk_index", "source", "text", "contribution"))).alias("references"))
    return answers.join(references, "query_id", "left")


@dataclass(frozen=True)
class Setting:
    """One way of answering, by name."""

    name: str
    embedder: Embedder
    generator: Generator
    k: int = 4
    kk: int | None = None
    reranker: Reranker | None = None
    window: int = 2


def with_models(base: Setting, generators: dict[str, Generator]) -> list[Setting]:
    return [replace(base, name=name, generator=g) for name, g in generators.items()]


def with_and_without(base: Setting, reranker: Reranker) -> list[Setting]:
    return [replace(base, name="without reranking", reranker=None, kk=None), replace(base, name="with reranking", reranker=reranker)]


def with_sizes(base: Setting, sweep: str) -> list[Setting]:
    """One setting for each of 'k=5:kk=3, k=10'; hits are reranked only where fewer are kept than found."""
    return [replace(base, name=name, k=k, kk=kk if kk != k and base.reranker else None, reranker=base.reranker if kk != k else None) for name, k, kk in parse_sweep(sweep)]


def compare(store: ChunkStore, questions: DataFrame, settings: list[Setting]) -> DataFrame:
    """answer() of each setting, with its name in config: one row a question and setting."""
    one = lambda s: answer(store, questions, s.embedder, s.generator, s.k, s.window, reranker=s.reranker, kk=s.kk).withColumn("config", F.lit(s.name))
    return reduce(DataFrame.unionByName, map(one, settings))
