"""Mixing sources to target weights by pivotal dependent rounding, with a reduction tree for what stays fractional."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, placed, saved, shipped, table, words


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order weigh `weights`, repeating. share times all sizes is dealt out by weight; a target stops
    at `most` times the size, and the excess goes to the others by weight, until none is above: target is the smaller of
    most * size and level * weight, and the level rises until what it gives is all there is to give.
    """
    known = saved(placed(sizes.withColumn("nil", F.col("source").isNull()), ["nil", "source"]).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(most)))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, last = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") < F.lit(level) * F.col("weight")
        n, given, weight = known.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == last or not weight:
            break
        last, level = n, max(0.0, share * total - given) / weight
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return known.select("source", "source_size", target.alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds p to 0 or 1 in place, but for one at most; returns its place or -1. Keeps sum(p * size) and each mean."""
    left = -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if left < 0:
            left = i
            continue
        up = min((1 - p[left]) * size[left], p[i] * size[i])  # words that `left` can take from i
        down = min(p[left] * size[left], (1 - p[i]) * size[i])
        moved = up if draws[i] * (up + down) < down else -down
        ends_left = moved == (1 - p[left]) * size[left] or moved == -p[left] * size[left]
        if ends_left:
            p[left] = 1.0 if moved > 0 else 0.0
            p[i] = min(1.0, max(0.0, p[i] - moved / size[i]))
            left = i if 0 < p[i] < 1 else -1
        else:
            p[left] = min(1.0, max(0.0, p[left] + moved / size[left]))
            p[i] = 0.0 if moved > 0 else 1.0
            left = left if 0 < p[left] < 1 else -1
    return left


def _round(items: DataFrame, last: bool, seed: int) -> DataFrame:
    """One level of the tree: each (source, bucket) is rounded on its own; at most one of its items stays fractional."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "h1", "h2"], kind="stable", ignore_index=True)
        first = xxhash.xxh64_intdigest(f"{seed}|{key[0]}|{key[1]}|{frame['order'].iloc[0]}")
        rng = np.random.default_rng(first)
        p = frame["p"].to_numpy(np.float64, copy=True)
        left = pivot(p, frame["size"].to_numpy(np.float64), rng)
        if last and left >= 0:
            p[left] = 1.0 if rng.random() < p[left] else 0.0
        frame["p"] = p
        return frame

    return shipped(items).groupBy("source_key", "bucket").applyInPandas(run, "source_key long, bucket long, h1 long, h2 long, order long, size double, p double")


def _dealt(numbers: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, bucket_rows: int, fan: int) -> DataFrame:
    """(h1, h2, size, n, source_size, target, whole, extra) from (h1, h2, draw, source, size, n): each row as often as `whole` says, `extra` of its n copies once more."""
    keyed = numbers.withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source"))
    by_source = keyed.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    goals = targets(by_source.select("source", "source_size"), weights, share, most)
    goals = goals.withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source")).join(by_source.select("source_key", "rows"), "source_key")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("want", wanted).withColumn("whole", F.floor("want")).withColumn("part", F.col("want") - F.col("whole"))
    goals = saved(goals.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows))))
    items = join_skewed(keyed.drop("source"), goals, ["source_key"], "rows", ["source_size", "target", "whole", "part", "buckets"], F.col("h1"))
    # of n copies alike, floor(n * part) are taken once more; what is left of one copy is rounded against other rows
    due = F.when(F.col("size") > 0, F.col("n") * F.col("part")).otherwise(F.lit(0.0))
    items = items.withColumn("extra", F.floor(due)).withColumn("p", due - F.floor(due))
    live = items.filter("p > 0").select("source_key", F.pmod(F.xxhash64(F.lit(seed), "draw"), "buckets").alias("bucket"), "h1", "h2", F.xxhash64(F.lit(seed + 1), "draw").alias("order"), F.col("size").cast("double").alias("size"), "p")
    wide = int(goals.agg(F.max("buckets")).first()[0] or 1)
    done = []
    while True:
        now = saved(_round(live, wide == 1, seed))
        done.append(now.filter("p = 1").select("h1", "h2"))
        if wide == 1:
            break
        live = now.filter("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / fan))
        wide = -(-wide // fan)
    up = done[0]
    for more in done[1:]:
        up = up.union(more)
    out = items.join(up.withColumn("up", F.lit(1)), ["h1", "h2"], "left")
    return out.select("h1", "h2", "size", "n", "source_size", "target", "whole", (F.col("extra") + F.coalesce("up", F.lit(0))).alias("extra"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 2_000, fan: int = 1_000, at_once: int = 10_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns `carry` of docs (all, if None), and size, source_size, target, copies: how often the mix takes a row.

    size: words of the text, null: 0. Each row of a source is wanted target / source_size times. The whole part of that
    is taken; what is left is rounded by pivoting: pairs of rows pass words between them at random until one of the two
    is taken or not, so the words taken from a source keep their sum but for its last row. Rows are dealt into buckets of
    about bucket_rows within a source; what stays fractional in a bucket, one row, goes up a tree of fan `fan`.

    Null source: a source of its own, last in order. Null ids are ids like any other. Rows alike in id, source, text and
    carried columns are counted once, by two hashes: of n such rows the whole part of n times the fraction is taken once
    more, and only the rest of one row is rounded, so repeated rows move a source's words by one row at most. They are
    spelt out again at_once at a time. Rows without words: size 0, taken as often as the whole part says. Draws come from
    hashes of `seed` and the rows, so reruns agree whatever the partitions. Empty input: empty output. Columns named size,
    source_size, target or copies are replaced.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "source_size", "target", "copies")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in own))
    whole_row = F.to_json(row) if "map<" in docs.select(row.alias("r")).schema.simpleString() else row  # maps have no hash
    told = [F.col(source_col).isNull(), F.col(source_col), F.col(id_col).isNull(), F.col(id_col), text]
    rows = docs.select(F.xxhash64(*told, whole_row).alias("h1"), F.xxhash64(F.lit(1), *told, whole_row).alias("h2"), F.xxhash64(*told).alias("draw"), F.col(source_col).alias("source"), F.size(words(text)).cast("long").alias("size"), row.alias("_tz_row"))
    numbers = saved(rows.groupBy("h1", "h2", "draw", "source", "size").agg(F.count("*").alias("n")))
    dealt = _dealt(numbers, weights, share, most, seed, bucket_rows, fan)
    repeats = numbers.agg(F.max("n")).first()[0] or 0
    copies = (F.col("whole") + (F.col("_tz_at") <= F.col("extra")).cast("long")).cast("long")
    if repeats <= 1:  # no row stands twice: nothing to gather or spell out
        out = rows.select("h1", "h2", "_tz_row").join(dealt, ["h1", "h2"]).withColumn("_tz_at", F.lit(1))
        return out.select("_tz_row.*", "size", "source_size", "target", copies.alias("copies"))
    once = rows.groupBy("h1", "h2").agg(F.first("_tz_row").alias("_tz_row"))
    spelt = dealt.withColumn("_tz_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / at_once) - 1)))
    out, begin = once.join(spelt, ["h1", "h2"]), F.col("_tz_part") * at_once
    if repeats > at_once:
        out = out.repartition("h1", "h2", "_tz_part")
    out = out.withColumn("_tz_at", F.explode(F.sequence(begin + 1, F.least(F.col("n"), begin + at_once))))
    return out.select("_tz_row.*", "size", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says, with the columns of docs."""
    own = {c: f"_tz_own_{c}" for c in docs.columns if c in ("size", "source_size", "target", "copies")}
    found = mix(docs.withColumnsRenamed(own), **options).filter("copies > 0").withColumn("_tz_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    found = found.select(*(f"`{own.get(c, c)}`" for c in docs.columns))
    return found.withColumnsRenamed({v: k for k, v in own.items()})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
