"""A saved index for exact search: vectors in clusters, a ball around each, and queries that skip the balls that can't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import better_first
from tessera.operators.search import _kept
from tessera.sources.code import shipped
from tessera.sources.saved import saved

#: Clusters at most, and vectors at most from which their centres are learned.
MOST_CLUSTERS, SAMPLE = 4096, 50_000
BLOCK_ROWS = 50_000
BOUNDS = "cluster int, centre array<double>, radius double, n long"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


class VectorIndex:
    """Clusters of vectors at a path, for one kind of score: l2sq, or cosine_distance (then balls are those of unit vectors).

    vectors/cluster=N holds id and vector; bounds holds, for each cluster and each time that rows were added, the centre, the
    radius of the ball around it that holds those rows, and their number. An index is fitted on a bounded sample, but holds every row; it's exact
    whatever the centres are.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "l2sq"):
        if kind not in ("l2sq", "cosine_distance"):
            raise ValueError(f"no balls for {kind}")
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def build(self, vectors: DataFrame, clusters: int | None = None, seed: int = 5) -> VectorIndex:
        """Learns centres from at most SAMPLE rows of vectors (id, vector) and adds all rows; about sqrt(n) clusters, if not said."""
        rows = self._sound(vectors)
        n = rows.count()
        k = max(1, min(MOST_CLUSTERS, clusters or int(n**0.5)))
        part = rows.sample(fraction=min(1.0, SAMPLE / n), seed=seed) if n > SAMPLE else rows
        if k < 2 or n < 2:
            first = rows.limit(1).collect()
            return self._appended(rows, np.array([r.vector for r in first], np.float64))
        points = part.select(array_to_vector("vector" if self.kind == "l2sq" else F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, y: a + y * y)))).alias("features"))
        return self._appended(rows, np.array(KMeans(k=k, maxIter=8, seed=seed, initSteps=1).fit(points).clusterCenters(), np.float64))

    def add(self, vectors: DataFrame) -> None:
        """Adds rows to the clusters that are nearest; ids that are there already are the caller's affair."""
        self._appended(self._sound(vectors), self._bounds()[1])

    def _sound(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.filter("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        return rows if self.kind == "l2sq" else rows.filter(F.exists("vector", lambda x: x != 0))

    def _appended(self, rows: DataFrame, centres: np.ndarray) -> VectorIndex:
        centres = centres.reshape(len(centres), -1)
        if self.kind != "l2sq":
            centres = _unit(centres)
        kind, shared = self.kind, self.spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                v = v if kind == "l2sq" else _unit(v)
                near = ((c * c).sum(axis=1)[None, :] - 2 * v @ c.T).argmin(axis=1)
                away = np.sqrt(((v - c[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["id", "vector", "cluster", "away"])

        placed = saved(shipped(rows).mapInArrow(run, "id long, vector array<double>, cluster int, away double"))
        centre = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
        bounds = placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(F.broadcast(centre), "cluster")
        placed.drop("away").repartition("cluster", F.pmod("id", F.lit(8))).write.mode("append").partitionBy("cluster").parquet(f"{self.path}/vectors")
        bounds.select("cluster", "centre", "radius", "n").write.mode("append").parquet(f"{self.path}/bounds")
        return self

    def _bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each cluster its number, centre, radius and size: MOST_CLUSTERS rows at most."""
        rows = self.spark.read.schema(BOUNDS).parquet(f"{self.path}/bounds").groupBy("cluster").agg(F.first("centre").alias("c"), F.max("radius").alias("r"), F.sum("n").alias("n")).orderBy("cluster").collect()
        return np.array([r.cluster for r in rows], np.int32), np.array([r.c for r in rows], np.float64).reshape(len(rows), -1), np.array([r.r for r in rows]), np.array([r.n for r in rows], np.int64)

    def search(self, queries: DataFrame, k: int, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
        """(hits, read): hits as search.top_k() gives them, and for each query the rows it was held against, and all rows.

        First each query meets the nearest clusters that hold k rows and one more; no cluster whose ball lies beyond the k-th best of those can
        hold a better row, so only the others follow. Only the clusters that some query meets are read (a partition filter). A large cluster is
        dealt into blocks; no side is broadcast but the balls.
        """
        if k < 1:
            raise ValueError("k must be positive")
        kind, bounds = self.kind, self._bounds()
        asks = queries.filter("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        shared = self.spark.sparkContext.broadcast(bounds)
        scale = 1.0 if kind == "l2sq" else 2.0

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of (query_id, vector, most): clusters in order of nearness until they hold k + 1 rows (most is null), or those within reach that the first turn didn't meet."""
            number, c, radius, n = shared.value
            for b in batches:
                rows, to = [], []
                for i, (v, most) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    q = np.array(v, np.float64)
                    if len(q) != c.shape[1] or not len(number):
                        continue
                    q = q if kind == "l2sq" else _unit(q[None, :])[0]
                    away = np.sqrt(((c - q) ** 2).sum(axis=1))
                    order = np.argsort(away, kind="stable")
                    first = order[: int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1]
                    if most is None:
                        take = first
                    else:  # a hair wider than the sums are exact
                        rest = np.setdiff1d(order, first)
                        take = rest[np.maximum(0.0, away[rest] - radius[rest]) ** 2 <= most * scale * (1 + 1e-9) + 1e-12]
                    rows += [i] * len(take)
                    to += number[take].tolist()
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(to, pa.int32())], names=["query_id", "vector", "cluster"])

        def turn(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
            met = saved(shipped(asked).mapInArrow(choose, "query_id long, vector array<double>, cluster int"))
            wanted = [r.cluster for r in met.select("cluster").distinct().collect()]
            return met, self._meet(met, wanted, dict(zip(bounds[0].tolist(), bounds[3].tolist())), k, exclude_self)

        met1, hits1 = turn(asks.withColumn("most", F.lit(None).cast("double")))
        hits1 = saved(hits1)
        worst = hits1.groupBy("query_id").agg(F.max("score").alias("most"), F.count("*").alias("n"))
        worst = worst.select("query_id", F.when(F.col("n") >= k, F.col("most")).otherwise(F.lit(float("inf"))).alias("most"))
        met2, hits2 = turn(asks.join(worst, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))))
        order = W.partitionBy("query_id").orderBy(better_first(F.col("score"), kind), "id")
        hits = hits1.unionByName(hits2).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        sizes = self.spark.createDataFrame(list(zip(bounds[0].tolist(), bounds[3].tolist())), "cluster int, n long")
        read = met1.unionByName(met2).join(F.broadcast(sizes), "cluster").groupBy("query_id").agg(F.sum("n").alias("rows_met"))
        return hits, read.withColumn("rows", F.lit(int(bounds[3].sum())).cast("long"))

    def _meet(self, met: DataFrame, wanted: list[int], sizes: dict[int, int], k: int, exclude_self: bool) -> DataFrame:
        """(query_id, id, score): the k best of each query in each block of the clusters that it meets."""
        kind = self.kind
        vectors = self.spark.read.schema("id long, vector array<double>, cluster int").parquet(f"{self.path}/vectors").filter(F.col("cluster").isin(wanted))
        many = [(c, -(-sizes[c] // BLOCK_ROWS)) for c in wanted]
        blocks = F.broadcast(self.spark.createDataFrame(many, "cluster int, blocks int"))
        left = vectors.join(blocks, "cluster").select("cluster", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vector", F.lit(False).alias("asks"))
        right = met.join(blocks, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("query_id").alias("id"), "vector", F.lit(True).alias("asks"))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            asked, some = frame[frame["asks"]].sort_values("id"), frame[~frame["asks"]].sort_values("id")
            if not len(asked) or not len(some):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            q, c = (np.stack(x["vector"].to_numpy()) for x in (asked, some))
            step = max(1, 4_000_000 // len(c))
            return pd.concat([_kept(q[at:at + step], asked["id"].to_numpy()[at:at + step], c, some["id"].to_numpy(), k, kind, exclude_self) for at in range(0, len(q), step)])

        return shipped(left.unionByName(right)).groupBy("cluster", "block").applyInPandas(run, "query_id long, id long, score double")
