"""Models: a registry of embedding models, and the interfaces of pluggable ones with deterministic local stand-ins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.code import shipped

#: Name, price of 1000 tokens, most tokens, dimension.
EMBEDDING_MODELS = [
    ("text-embedding-ada-002", 0.0001, 8191, 1536),
    ("text-embedding-3-small", 0.00002, 8191, 1536),
    ("text-embedding-3-large", 0.00013, 8191, 3072),
    ("bge-m3", 0.0, 8192, 1024),
    ("nomic-embed-text", 0.0, 8192, 768),
]


def registry(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{n}', {c!r}D, {m}, {d})" for n, c, m, d in EMBEDDING_MODELS).replace("e-05D", "e-5D")
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, cost_per_1k_tokens, max_tokens, dimension)")


def embedding_cost(tokens: Column, per_thousand: Column) -> Column:
    return tokens / 1000.0 * per_thousand


def model_billions(name: Column) -> Column:
    """The size a model's name tells, in billions; 1 if it tells none."""
    out = F.lit(1.0)
    for size in reversed(("1", "2", "3", "4", "7", "9", "14")):
        out = F.when(F.lower(name).rlike(rf"{size}(b|\.b)"), float(size)).otherwise(out)
    return out


def similar_models(wanted: str, available: list[str]) -> list[str]:
    """Up to three names like the wanted one, else two of each common family."""
    parts = [p for p in wanted.lower().split() if len(p) > 2]
    near = [m for m in available if any(p in m.lower() for p in parts)]
    if not near:
        near = [m for family in ("llama", "gemma", "mistral", "phi", "qwen") for m in [x for x in available if family in x.lower()][:2]]
    return list(dict.fromkeys(near))[:3]


class Embedder(Protocol):
    """Texts to vectors of one dimension. An implementation is pickled to the workers; it loads its model on first use."""

    dimension: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A stand-in without a model: signed hashed counts of lower-cased words, scaled to length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(df: DataFrame, model: Embedder, text_col: str = "text", to: str = "vector", batch: int = 100) -> DataFrame:
    """df with vectors, batch by batch. A batch that fails, fails the task, which Spark retries: no vector goes missing."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.ArrayType(T.FloatType()))])
    names = [f.name for f in schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch].copy()
                part[to] = model.embed_documents(part[text_col].fillna("").tolist())
                yield part[names]

    return shipped(df).mapInPandas(run, schema)


class Generator(Protocol):
    """A prompt's parts to an answer."""

    def generate(self, question: str, context: str) -> str: ...


class ExtractiveGenerator:
    """A stand-in without a model: the context's sentence that shares most words with the question, or that it doesn't know."""

    unknown = "I don't know"

    def generate(self, question: str, context: str) -> str:
        asked = set(re.findall(r"\w+", question.lower()))
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", context or "") if s.strip()]
        best = max(sentences, key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default="")
        return best if asked & set(re.findall(r"\w+", best.lower())) else self.unknown


def generate(df: DataFrame, model: Generator, question_col: str = "question", context_col: str = "context", to: str = "answer") -> DataFrame:
    """df with answers, by an Arrow-batched function."""

    @F.pandas_udf("string")
    def run(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([model.generate(q or "", c or "") for q, c in zip(question, context)])

    return shipped(df).withColumn(to, run(F.col(question_col), F.col(context_col)))


class Reranker(Protocol):
    """Pairs of question and text to scores, higher is better."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class KeywordReranker:
    """A stand-in without a model: the share of the question's words that the text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            asked = set(q.lower().split())
            out.append(len(asked & set(t.lower().split())) / len(asked) if asked else 0.5)
        return out


class ModelReranker:
    """A reranker over any generator of text: the number that it says about a question and a passage, as a share."""

    def __init__(self, say: Callable[[str], str]):
        self.say = say

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            reply = self.say(f"Query: {q}\nPassage: {t}").strip()
            found = re.search(r"\d+\.?\d*", reply)
            number = float(found[0]) if found else len(reply) / 100
            out.append(min(1.0, number / 100 if found and number > 1 else number))
        return out


#: Rerankers by name; a factory takes keyword arguments. Hosted and local models are entered here by whoever has them.
RERANKERS: dict[str, Callable[..., "Reranker"]] = {"keyword": KeywordReranker, "model": ModelReranker}


def reranker(name: str, **options) -> "Reranker":
    if name not in RERANKERS:
        raise ValueError(f"unknown reranker: {name}; known: {sorted(RERANKERS)}; like it: {similar_models(name, sorted(RERANKERS))}")
    return RERANKERS[name](**options)


#: What happens to a hit that a reranker fails on; a number is the score of that hit.
ON_ERROR = ("raise", "keep_score", "keep_order")


def score_pairs(df: DataFrame, model: Reranker, question_col: str = "question", text_col: str = "text", to: str = "rerank_score", on_error: float | str = "raise", score_col: str = "score", query_col: str = "query_id") -> DataFrame:
    """df with scores and an `error` column, batch by batch.

    A batch that fails is scored row by row; a row that fails says why, and goes by on_error: 'raise' fails the task;
    'keep_score' takes the row's own score; 'keep_order' gives all hits of its query the score 0, so that they keep their
    order; a number is its score.
    """
    if isinstance(on_error, str) and on_error not in ON_ERROR:
        raise ValueError(f"on_error must be a number or one of {ON_ERROR}")
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in (to, "error")), T.StructField(to, T.DoubleType()), T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = list(zip(frame[question_col].fillna(""), frame[text_col].fillna("")))
            own = frame[score_col].tolist() if on_error == "keep_score" else [0.0 if on_error == "keep_order" else on_error] * len(pairs)
            errors: list[str | None] = [None] * len(pairs)
            try:
                scores = [float(x) for x in model.score(pairs)]
            except Exception:
                if on_error == "raise":
                    raise
                scores = []
                for i, p in enumerate(pairs):
                    try:
                        scores.append(float(model.score([p])[0]))
                    except Exception as e:  # noqa: BLE001 - a model may raise anything; it's reported in its row
                        scores.append(float(own[i]))
                        errors[i] = f"{type(e).__name__}: {e}"
            yield frame.assign(**{to: scores, "error": errors})[names]

    out = shipped(df).mapInPandas(run, schema)
    if on_error == "keep_order":
        failed = F.max(F.col("error").isNotNull()).over(W.partitionBy(query_col))
        out = out.withColumn(to, F.when(failed, F.lit(0.0)).otherwise(F.col(to)))
    return out


class Fallback:
    """A generator that asks each of several in turn, until one gives an answer that isn't blank."""

    def __init__(self, *generators: Generator):
        self.generators = generators

    def generate(self, question: str, context: str) -> str:
        last: Exception | None = None
        for g in self.generators:
            try:
                said = g.generate(question, context)
            except Exception as e:  # noqa: BLE001 - a model may raise anything; the next one is asked
                last = e
                continue
            if said and said.strip():
                return said
        if last:
            raise RuntimeError("no generator could answer") from last
        return ""


def probe(model: object) -> tuple[bool, str]:
    """Whether a model answers a small request, and what it said or raised."""
    asks = {"embed_documents": (["probe"],), "generate": ("probe", "probe"), "score": ([("probe", "probe")],)}
    for name, given in asks.items():
        if hasattr(model, name):
            try:
                return True, f"{name}: {type(getattr(model, name)(*given)).__name__}"
            except Exception as e:  # noqa: BLE001 - a probe tells what a model raises
                return False, f"{name}: {type(e).__name__}: {e}"
    return False, "neither an embedder, a generator nor a reranker"


def embed_query(model: Embedder, text: str) -> list[float]:
    """The vector of one text."""
    return model.embed_documents([text])[0]
