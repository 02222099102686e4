"""Context expansion: a hit's neighbouring chunks, ranges merged where they touch, chunks joined to ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(hits: DataFrame, window: int = 2) -> DataFrame:
    """hits (source, chunk_index, total_chunks, score) with start and end: the chunks up to `window` away that can exist."""
    return hits.withColumn("start", F.greatest(F.lit(0), F.col("chunk_index") - window)).withColumn("end", F.least(F.col("total_chunks") - 1, F.col("chunk_index") + window))


#: Places of one segment of a source, and chunks of one bin.
SEGMENT, BIN = 4096, 256


def _islands(ranges: DataFrame, by: list[str], best: F.Column) -> DataFrame:
    """(by, start, end, score, hits): ranges (by, start, end, score, hits) that overlap or follow one another, made one, in a window by `by`."""
    order = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = ranges.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("score"), F.sum("hits").alias("hits")).drop("island")


def merge_ranges(ranges: DataFrame, by: list[str], lower_is_better: bool = True, compat: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """(by, start, end, score, hits): ranges that overlap or follow one another become one, with the best of their scores.

    compat='min': the smallest score, whichever way is better, as the original does even after reranking.

    No task sees all ranges of a source: they are merged by segments of `segment` places of their starts. What lies before a
    segment can meet only the islands that begin within its reach (they are one then), and of a segment only the island that reaches
    furthest can go beyond it; so two rows a segment are merged in a second pass, and the other islands are whole already.
    """
    lower_is_better = lower_is_better or compat == "min"
    best = F.min("score") if lower_is_better else F.max("score")
    cut = F.floor(F.col("start") / segment)
    local = _islands(ranges.select(*by, "start", "end", "score", F.lit(1).cast("long").alias("hits"), cut.alias("_segment")), [*by, "_segment"], best)
    names = [f"_by{i}" for i in range(len(by))]
    ends = local.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col("_segment").alias("_seg")).agg(F.max("end").alias("_most"))
    before = F.max("_most").over(W.partitionBy(*names).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("_reach", before)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)] + [F.col("_segment") == F.col("_seg")]
    met = local.join(ends, on).withColumn("_head", F.coalesce(F.col("start") <= F.col("_reach") + 1, F.lit(False))).withColumn("_edge", F.col("_head") | (F.col("end") == F.col("_most")))
    columns = [*by, "start", "end", "score", "hits"]
    heads = met.filter("_head").groupBy(*by, "_segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("score"), F.sum("hits").alias("hits")).select(columns)
    edges = heads.unionByName(met.filter("_edge and not _head").select(columns))
    return _islands(edges, by, best).unionByName(met.filter("not _edge").select(columns))


def expand(ranges: DataFrame, chunks: DataFrame, by: list[str], keep: list[str] | None = None, bin_size: int = BIN) -> DataFrame:
    """ranges with text (the chunks of the range in order, a blank line between), first_chunk and chunk_count.

    An equi-join on `by` and bins of chunk_index, each range dealt to the bins that it meets, with the range as its residual
    condition: a task holds a few hundred chunks of a source and what asks for them, however long the source. `keep` are further columns of ranges, which tell alike
    ranges apart. A range of which no chunk exists has no text.
    """
    own = [*by, *(keep or []), "start", "end", "score"]
    bin_of = lambda c: F.floor(F.col(c) / bin_size)
    dealt = ranges.select(*own, F.explode(F.sequence(bin_of("start"), F.greatest(bin_of("start"), bin_of("end")))).alias("_bin"))
    same = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in by] + [F.col("r._bin") == F.col("c._bin"), F.col("c.chunk_index").between(F.col("r.start"), F.col("r.end"))]
    joined = dealt.alias("r").join(chunks.withColumn("_bin", bin_of("chunk_index")).alias("c"), same, "left")
    part = F.struct(F.col("c.chunk_index").alias("i"), F.col("c.text").alias("t"))
    got = joined.groupBy(*(F.col(f"r.{c}").alias(c) for c in own)).agg(F.array_sort(F.collect_list(F.when(F.col("c.chunk_index").isNotNull(), part))).alias("parts"))
    return got.select(*own, F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n").alias("text"), F.get("parts", 0)["i"].alias("first_chunk"), F.size("parts").alias("chunk_count"))


def sizes(expanded: DataFrame, by: list[str]) -> DataFrame:
    """(by, contexts, context_chars, mean_chars): the whole mean, as whole numbers."""
    return expanded.groupBy(*by).agg(F.count("*").alias("contexts"), F.sum(F.length("text")).alias("context_chars"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("mean_chars"))


def grouped(hits: DataFrame, source: str = "source") -> DataFrame:
    """hits (query_id, rank, source, ...) with source_place from 1 and place_in_source from 1: sources in the order in which they are first seen."""
    first = F.min("rank").over(W.partitionBy("query_id", source))
    out = hits.withColumn("_first", first).withColumn("source_place", F.dense_rank().over(W.partitionBy("query_id").orderBy("_first", source)))
    return out.withColumn("place_in_source", F.row_number().over(W.partitionBy("query_id", source).orderBy("rank"))).drop("_first")


def expand_hits(hits: DataFrame, chunks: DataFrame, window: int = 2, lower_is_better: bool = True, compat: bool = False) -> DataFrame:
    """(query_id, place from 1, source, chunk_index, expanded_range, expansion_window, chunk_count, score, rank, text): what the hits become.

    hits: query_id, rank, source, chunk_index, total_chunks, score, text; chunks: source, chunk_index, text. Hits of a
    source whose ranges touch become one text; its chunk_index is that of the first chunk found, its rank that of the hit
    that begins the range, its expanded_range 'start-end' and its expansion_window the number of chunks sought. A range of
    which no chunk is found keeps the text and index of that hit. A hit without a place (no chunk_index or total_chunks),
    and every hit if window is 0, stays as it is, without range and counts.

    The best score comes first, ties by rank. compat: by source in the order first seen, hits without a place before the
    ranges of their source, and the smallest score of a range.
    """
    own = ["query_id", "source", "rank", "chunk_index", "score", "text"]
    no_place = F.col("chunk_index").isNull() | F.col("total_chunks").isNull() | F.lit(window == 0)
    order = grouped(hits).groupBy("query_id", "source").agg(F.min("source_place").alias("source_place"))
    alone = hits.filter(no_place).select(*own, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("int").alias("chunk_count"))
    near = neighbours(hits.filter(~no_place), window)
    by = ["query_id", "source"]
    ranges = merge_ranges(near, by, lower_is_better, "min" if compat else None).drop("hits")
    begins = near.groupBy(*by, "start").agg(F.min(F.struct("rank", "chunk_index", "text")).alias("hit"))
    found = expand(ranges, chunks, ["source"], ["query_id"]).join(begins, [*by, "start"])
    some = F.col("chunk_count") > 0
    wide = found.select(*by, F.col("hit.rank").alias("rank"), F.when(some, F.col("first_chunk")).otherwise(F.col("hit.chunk_index")).alias("chunk_index"), "score", F.when(some, F.col("text")).otherwise(F.col("hit.text")).alias("text"), "start", "end", "chunk_count")
    all_ = alone.unionByName(wide.select(alone.columns)).join(order, by)
    better = F.col("score") if lower_is_better else -F.col("score")
    keys = ["source_place", F.col("start").isNotNull(), F.coalesce("start", "rank")] if compat else [better, "rank", F.col("start").isNotNull()]
    all_ = all_.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*keys)))
    ranged = F.when(F.col("start").isNotNull(), F.concat_ws("-", "start", "end"))
    return all_.select("query_id", "place", "source", "chunk_index", ranged.alias("expanded_range"), (F.col("end") - F.col("start") + 1).alias("expansion_window"), "chunk_count", "score", "rank", "text")
