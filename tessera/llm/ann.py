"""Approximate nearest neighbours by shifted space-filling curves: Hilbert orderings, key windows merged and reranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, placed, saved, shipped, table


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (a row of whole coordinates under 2^bits) on the Hilbert curve through the grid.

    Coordinates become the curve's transposed index (after Skilling 2004): from the highest bit down, each axis either
    inverts or swaps the lower bits of the first; Gray coding follows; then the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for a in range(axes):
            inverts = (x[a] >> level) & 1 == 1
            swap = np.where(inverts, 0, (x[0] ^ x[a]) & low)
            x[0] = np.where(inverts, x[0] ^ low, x[0] ^ swap)
            x[a] = x[a] if a == 0 else x[a] ^ swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned = np.where((x[-1] >> level) & 1 == 1, turned ^ ((1 << level) - 1), turned)
    x ^= turned
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << 1) | ((x[a] >> level) & 1)
    return key


@dataclass
class Curves:
    """Orderings: of each a rotation to `axes` dimensions and a shifted grid."""

    turns: list[np.ndarray]
    low: list[np.ndarray]
    side: list[np.ndarray]
    bits: int
    reach: float  # the largest norm

    def raised(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on one sphere, where the largest inner product is the smallest distance."""
        norm = np.linalg.norm(v, axis=1)
        if query:
            return np.hstack([v * (self.reach / norm)[:, None], np.zeros((len(v), 1))])
        return np.hstack([v, np.sqrt(np.maximum(0.0, self.reach**2 - norm**2))[:, None]])

    def keys(self, o: int, raised: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Places on curve o, with bits of a hash below, so that one cell can be cut as well."""
        cells = np.clip((raised @ self.turns[o] - self.low[o]) / self.side[o], 0, 1 - 1e-9) * (1 << self.bits)
        spare = 62 - self.bits * self.turns[o].shape[1]
        return (hilbert(cells.astype(np.int64), self.bits) << spare) | (salt & ((1 << spare) - 1))


def fit(sample: np.ndarray, reach: float, orders: int, axes: int, bits: int, seed: int) -> Curves:
    """Curves over a sample of vectors; each has a rotation and a shift of its own."""
    rng = np.random.default_rng(seed)
    axes = min(axes, sample.shape[1] + 1)
    c = Curves([], [], [], bits, reach)
    raised = c.raised(sample, query=False)
    for _ in range(orders):
        turn = np.linalg.qr(rng.normal(size=(raised.shape[1], raised.shape[1])))[0][:, :axes]
        y = raised @ turn
        lo, hi = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
        width = np.maximum(hi - lo, 1e-12)
        c.turns.append(turn)
        c.low.append(lo - rng.random(axes) * width / 4)
        c.side.append(width * 1.25)
    return c


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _best(q: np.ndarray, c: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, inner product) of the `keep` best rows of c for each of q; earlier rows of c win ties."""
    rough = q @ c.T
    m = min(len(c), keep + 8)
    if m < len(c):
        top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
        edge = np.take_along_axis(rough, top, 1).min(axis=1)
        i, j = np.nonzero(rough >= (edge - 1e-12 * np.abs(edge))[:, None])  # all that tie with the last
    else:
        i, j = np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
    s = np.cumsum(q[i] * c[j], axis=1)[:, -1]  # in order, so the same in any block
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return i[first], j[first], s[first]


def window(unique: DataFrame, places: DataFrame, d: int, k: int, probes: int, recall: float) -> int:
    """How far around a query's place one must look, in any of the orderings, to meet `recall` of its k nearest.

    Measured: the nearest of `probes` queries (chosen by a hash) among all vectors, and how far from them they are in the
    orderings. What comes to the driver, the probes and k places for each, is bounded by the two numbers.
    """
    some = unique.filter("asks").orderBy(F.xxhash64("u", F.lit(5)), "u").limit(probes).select("u", "v").collect()
    if not some:
        return 1
    asked, ids = np.array([r.v for r in some], np.float64), np.array([r.u for r in some], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j, s = _best(asked, _matrix(b.column(1), d), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(b.column(0).to_numpy()[j]), pa.array(s)], names=["q", "u", "s"])

    near = shipped(unique.select("u", "v")).mapInArrow(run, "q long, u long, s double").filter("q <> u")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "u"))).filter(F.col("n") <= k).select("q", "u")
    near = saved(near)
    asks = places.filter("asks").join(F.broadcast(near.select(F.col("q").alias("u")).distinct()), "u").select("o", F.col("u").alias("q"), F.col("place").alias("from"))
    held = places.filter("not asks").join(F.broadcast(near), "u").select("o", "q", "u", "place")
    gaps = held.join(F.broadcast(asks), ["o", "q"]).groupBy("q", "u").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap")).orderBy("gap")
    found = [r.gap for r in gaps.select("gap").collect()]
    return max(1, found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if found else 1


def _search(rows: DataFrame, d: int, k: int, orders: int, axes: int, bits: int, least: int, block_bytes: int, recall: float, probes: int, sample: int, seed: int) -> DataFrame:
    """(id, list of (s, id, u), u) for the asking rows (id, v, h1, h2, asks) of one length d; s is less the score."""
    spark = rows.sparkSession
    kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64  # as vectors travel
    first = rows.select("id", "h1", "h2").withColumn("n", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= k + 1)
    first = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    same = rows.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.max("asks").alias("asks"), F.sum(F.col("asks").cast("long")).alias("askers"))
    unique = saved(same.join(first, ["h1", "h2"]).withColumn("u", F.monotonically_increasing_id()))  # a number for each vector
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, asking, reach = unique.agg(F.count("*"), F.count_if("asks"), F.max(norm)).first()
    unit = F.pmod(F.xxhash64("h1", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    some = np.array([r.v for r in unique.filter(unit < sample / n).select("v").orderBy("v").collect()], np.float64).reshape(-1, d)
    curves = spark.sparkContext.broadcast(fit(some if len(some) else np.eye(1, d) * reach, reach, orders, axes, bits, seed))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = curves.value
        for b in batches:
            if not b.num_rows:
                continue
            v, u, salt, asks = _matrix(b.column(2), d), b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for role in (False, True):
                pick = np.flatnonzero(asks) if role else np.arange(len(v))
                raised = c.raised(v[pick], query=role)
                for o in range(len(c.turns)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), o), pa.int32()), pa.array(c.keys(o, raised, salt[pick])), pa.array(np.full(len(pick), role)), pa.array(u[pick])], names=["o", "key", "asks", "u"])

    keys = shipped(unique).select("u", "h2", "v", "asks").mapInArrow(order, "o int, key long, asks boolean, u long")
    each = n + asking  # of one ordering
    places = placed(keys, ["o", "key", "asks", "u"], rows=each * orders).withColumn("place", F.col("place") - F.col("o") * each).select("o", "place", "asks", "u")
    half = window(unique, places, d, k, probes, recall)
    block = min(max(-(-half // 4), least), max(least, block_bytes // (d * np.dtype(kind).itemsize)))
    ends = [F.floor(x / block) for x in (F.greatest(F.lit(0), F.col("place") - half), F.least(F.lit(each - 1), F.col("place") + half))]
    blocks = F.when(F.col("asks"), F.sequence(*ends)).otherwise(F.array(F.floor(F.col("place") / block)))
    dealt = places.join(unique.select("u", F.get("ids", 0).alias("first"), "v"), "u").select("o", F.explode(blocks).alias("block"), "asks", "u", "first", "v")
    keep = k + 1

    def meet(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        out = {"q": [], "u": [], "s": []}
        q, c = t.filter(pa.array(asks)), t.filter(pa.array(~asks)).sort_by([("first", "ascending"), ("u", "ascending")])
        if q.num_rows and c.num_rows:
            cv, cu = _matrix(c.column("v").combine_chunks(), d), c.column("u").to_numpy()
            for part in q.to_batches(max_chunksize=max(1, 4_000_000 // len(cv))):
                i, j, s = _best(_matrix(part.column("v"), d), cv, keep)
                out["q"].append(part.column("u").to_numpy()[i])
                out["u"].append(cu[j])
                out["s"].append(s)
        kinds = {"q": pa.int64(), "u": pa.int64(), "s": pa.float64()}
        return pa.table({x: pa.array(np.concatenate(out[x]) if out[x] else [], kinds[x]) for x in kinds})

    found = dealt.groupBy("o", "block").applyInArrow(meet, "q long, u long, s double")
    found = found.groupBy("q", "u").agg(F.max("s").alias("s"))
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "id", "u"))
    merged = found.join(unique.select("u", "ids"), "u").select("q", "u", "s", F.explode("ids").alias("id")).withColumn("n", best).filter(F.col("n") <= k + 1)
    lists = merged.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "id", "u"))).alias("list"))
    lists = saved(lists.join(unique.select(F.col("u").alias("q"), "h1", "h2", "askers"), "q"))
    return join_skewed(rows.filter("asks").select("id", "h1", "h2"), lists, ["h1", "h2"], "askers", ["list", "q"], F.xxhash64("id"))


def nearest(vectors: DataFrame, query: str, k: int = 20, orders: int = 8, axes: int = 8, bits: int = 5, least: int = 512, block_bytes: int = 16 << 20, recall: float = 0.95, probes: int = 64, sample: int = 20_000, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for each row that the SQL condition `query` picks, the k rows of largest inner product found.

    Distinct vectors, and once more those that ask, are put in `orders` Hilbert orderings, each range-partitioned and
    numbered. A query meets the vectors around its own place in each ordering, at least as far as window() finds that it
    takes for `recall` of the nearest; what it finds is merged and scored in double precision on the vectors as they are.
    The window follows from the vectors alone: it is narrow where they have structure, and a share of the table where they
    have none. Orderings are cut into blocks of a quarter of the window's half (`least` places at least, block_bytes at
    most), so a task's memory is bounded. The grids are fitted on about `sample` vectors, chosen by a hash.

    Vectors that are null, zero, or hold a null or non-finite component take no part, neither do rows without an id.
    Vectors of one length are searched among themselves: there is no inner product between lengths. A row is its id and
    its vector: repeats of a row are one, and an id with several vectors is found, and asks, once for each. Equal vectors
    are searched once: the k + 1 smallest ids of each are all that a result can need. Ties go to the smaller id; fewer
    candidates: all of them. Other columns don't matter, whatever their names. Empty input: empty output.
    """
    spark = vectors.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(F.expr(query), F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    rows = saved(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}).groupBy("id", "h1", "h2").agg(F.min("v").alias("v"), F.max("asks").alias("asks")))
    out = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    for (d,) in sorted(rows.select(F.size("v")).distinct().collect()):
        asked = _search(rows.filter(F.size("v") == d), d, k, orders, axes, bits, least, block_bytes, recall, probes, sample, seed)
        own = asked.select(F.col("id").alias("query_id"), F.slice(F.filter("list", lambda x: (x["id"] != F.col("id")) | (x["u"] != F.col("q"))), 1, k).alias("list"))
        ranked = own.select("query_id", F.posexplode("list").alias("at", "x"))
        out = out.unionByName(ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score")))
    return out


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
