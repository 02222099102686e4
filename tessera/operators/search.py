"""Exact top-k search of many queries at once, reranking, several collections, and sweeps of k."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import LOWER_IS_BETTER, better_first
from tessera.sources.code import shipped


#: What the vectors of one block may take.
BLOCK_BYTES = 64 << 20


def top_k(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "l2sq", block_rows: int | None = None, query_rows: int | None = None, collection: str | None = None, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank from 1, id, score): the k nearest rows of vectors (id, vector) for each of queries (query_id, vector).

    Both sides are dealt into blocks, and each pair of blocks is one task's matrix product, which keeps k rows a query; a
    window over what the blocks kept gives the result. No side is broadcast and no pair of rows is ever a row. Scores are
    summed in order in double precision. Blocks hold block_rows and query_rows rows; if not given, 64 MB of the longest vectors. Ties go to the smaller id. With `collection`, a column of vectors, the k nearest
    of each collection are found, and the column is in the result. Null ids and vectors, and vectors of another length
    than the query's, take no part.
    """
    if k < 1:
        raise ValueError("k must be positive")
    lower = LOWER_IS_BETTER[kind]
    extra = [collection] if collection else []
    part = F.col(collection).cast("string") if collection else F.lit("")
    base = vectors.filter("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), part.alias("part"), F.col("vector").cast("array<double>").alias("vector"))
    asks = queries.filter("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    told = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    (n, longest), (m, _) = told(base), told(asks)
    if block_rows is None or query_rows is None:
        block_rows, query_rows = (x or max(1, min(most, BLOCK_BYTES // (8 * longest))) for x, most in ((block_rows, 50_000), (query_rows, 20_000)))
    width, height = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    columns, lines = (F.sequence(F.lit(0), F.lit(x - 1)) for x in (width, height))
    left = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(width)).cast("int")).withColumn("line", F.explode(lines)).withColumn("asks", F.lit(False))
    right = asks.withColumn("part", F.lit(None).cast("string")).withColumn("line", F.pmod(F.xxhash64("id"), F.lit(height)).cast("int")).withColumn("block", F.explode(columns)).withColumn("asks", F.lit(True))
    dealt = left.unionByName(right)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = frame.sort_values("id", kind="stable")
        for size, same in every.groupby(every["vector"].map(len)):
            asked = same[same["asks"]]
            for name, some in same[~same["asks"]].groupby("part", dropna=False):
                if not len(asked) or not size:
                    continue
                c, q = np.stack(some["vector"].to_numpy()), np.stack(asked["vector"].to_numpy())
                ids = some["id"].to_numpy()
                for at in range(0, len(q), step := max(1, 4_000_000 // len(c))):
                    out.append(_kept(q[at:at + step], asked["id"].to_numpy()[at:at + step], c, ids, k, kind, exclude_self).assign(part=name))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": [], "part": []})

    found = shipped(dealt).groupBy("line", "block").applyInPandas(meet, "query_id long, id long, score double, part string")
    over = ["query_id", "part"] if collection else ["query_id"]
    order = W.partitionBy(*over).orderBy(better_first(F.col("score"), kind), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = [F.col("part").cast(vectors.schema[collection].dataType).alias(collection)] if extra else []
    return ranked.select("query_id", *names, "rank", "id", "score")


def _kept(q: np.ndarray, qid: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, kind: str, exclude_self: bool) -> pd.DataFrame:
    """The k best of one pair of blocks: a rough product picks, a sum in order decides."""
    rough = q @ c.T
    if kind == "l2sq":
        rough = 2 * rough - (c * c).sum(axis=1)[None, :]
    elif kind.startswith("cosine"):
        rough = rough / np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-300)[None, :]
    m = min(len(c), k + 1 + 8)
    if m < len(c):
        edge = np.partition(-rough, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero(-rough <= edge[:, None] + 1e-12 * (1 + np.abs(edge))[:, None])
    else:
        i, j = np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
    if exclude_self:
        other = qid[i] != ids[j]
        i, j = i[other], j[other]
    total = lambda x: np.cumsum(x, axis=1)[:, -1] if x.size else np.zeros(0)
    a, b = q[i], c[j]
    if kind == "l2sq":
        score = total((a - b) * (a - b))
    elif kind == "inner_product":
        score = total(a * b)
    else:
        score = total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
        score = 1.0 - score if kind == "cosine_distance" else score
    order = np.lexsort((ids[j], score if LOWER_IS_BETTER[kind] else -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return pd.DataFrame({"query_id": qid[i[keep]], "id": ids[j[keep]], "score": score[keep]})


def rerank(hits: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """hits (query_id, rank, ...) with rerank_score, original_rank and new_rank (both from 0) and direction.

    Higher is better; ties keep the order of retrieval. new_rank is given before the cut to k.
    """
    out = hits.withColumn("rerank_score", score).withColumn("original_rank", F.col("rank") - 1)
    out = out.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "original_rank")) - 1)
    way = F.when(F.col("new_rank") < F.col("original_rank"), "up").when(F.col("new_rank") > F.col("original_rank"), "down").otherwise("same")
    out = out.withColumn("direction", way)
    return out if k is None else out.filter(F.col("new_rank") < k)


def merge_collections(hits: DataFrame, kind: str, k: int, collection: str = "collection") -> DataFrame:
    """One list a query from the lists of its collections: the better scores first, whichever way that is."""
    order = W.partitionBy("query_id").orderBy(better_first(F.col("score"), kind), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sweep(hits: DataFrame, ks: list[int]) -> DataFrame:
    """hits at the largest k, once for each k of the sweep: one search serves all of them."""
    return hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))


def parse_sweep(text: str) -> list[tuple[str, int, int]]:
    """'k=5:kk=3, k=10' and the like: (name, k, number kept after reranking, which is k where none is given)."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        found = re.fullmatch(r"k\s*=\s*(-?\d+)\s*(?::\s*kk\s*=\s*(-?\d+)\s*)?", part)
        if not found:
            raise ValueError(f"not 'k=N' or 'k=N:kk=M': {part!r}")
        k, kk = int(found[1]), int(found[2] or found[1])
        out.append((f"k={k}, kk={kk}" if found[2] else f"k={k}", k, kk))
    return out


def search_collections(names: list[str], one: Callable[[str], DataFrame], on_missing: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """The hits of several collections, each with its name in collection_name; one(name) gives those of one.

    A collection that can't be searched (it raises) is told to on_missing and left out; if none is left, that is a LookupError.
    """
    found = []
    for name in names:
        try:
            found.append(one(name).withColumn("collection_name", F.lit(name)))
        except Exception as e:  # noqa: BLE001 - a store may raise anything; it's told, and the others are searched
            if on_missing:
                on_missing(name, e)
    if not found:
        raise LookupError(f"none of the collections could be searched: {names}")
    return reduce(DataFrame.unionByName, found)
