"""Vector expressions: folds in double precision over arrays, one after another, so that results are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def l2sq(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def similarity(distance: Column) -> Column:
    """1 / (1 + d): a distance as a number that grows with nearness, for display."""
    return 1.0 / (1.0 + distance)


#: Which way each kind of score is better: carried with results so that none is sorted the wrong way.
LOWER_IS_BETTER = {"l2sq": True, "cosine_distance": True, "cosine_similarity": False, "inner_product": False, "rerank": False}


def better_first(score: Column, kind: str) -> Column:
    return score.asc() if LOWER_IS_BETTER[kind] else score.desc()
