"""Retrieval quality from ranked lists: ranks of first matches, MRR, hit rates, distributions, chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.saved import placed


def first_match(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, found_rank, success): the smallest rank with is_match, for every query, null where there is none."""
    found = hits.filter("is_match").groupBy("query_id").agg(F.min("rank").alias("found_rank"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("success", F.col("found_rank").isNotNull())


def until_match(hits: DataFrame) -> DataFrame:
    """hits up to the first match of each query, where the original stops looking."""
    first = F.min(F.when(F.col("is_match"), F.col("rank"))).over(W.partitionBy("query_id"))
    return hits.withColumn("found_rank", first).filter(F.col("found_rank").isNull() | (F.col("rank") <= F.col("found_rank")))


def metrics(results: DataFrame, k: int) -> DataFrame:
    """One row: totals, MRR, hit@1, hit@k, success rate and mean rank (infinite if nothing was found)."""
    rank = F.col("found_rank")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return results.agg(
        F.count("*").alias("total_questions"), F.count(rank).alias("successful"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"),
        share(F.coalesce(rank == 1, F.lit(False))).alias("hit_at_1"), share(F.coalesce(rank <= k, F.lit(False))).alias("hit_at_k"),
        share(rank.isNotNull()).alias("success_rate"), F.coalesce(F.avg(rank), F.lit(float("inf"))).alias("avg_position"),
    )


def possible_metrics(results: DataFrame, k: int) -> DataFrame:
    """metrics() without the questions that have no answer."""
    return metrics(results.filter(~F.coalesce(F.col("impossible"), F.lit(False))), k)


def by_k(results: DataFrame, k: int) -> DataFrame:
    """(k, mrr_at_k, accuracy) for 1 to k."""
    each = results.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    inside = F.coalesce(F.col("found_rank") <= F.col("k"), F.lit(False))
    return each.groupBy("k").agg(F.avg(F.when(inside, 1.0 / F.col("found_rank")).otherwise(0.0)).alias("mrr_at_k"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("accuracy"))


def rank_distribution(results: DataFrame) -> DataFrame:
    """(found_rank, n, share of all found): a few rows, one for each rank."""
    n = results.filter("found_rank is not null").groupBy("found_rank").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def rolling_success(results: DataFrame, order: str = "query_id") -> DataFrame:
    """(order, place, rolling): the trailing success rate over w results, null before there are w.

    w is 5, or a fifth of the results but 50 at most if there are over 20. Places are counted in range partitions, and
    each partition takes the last rows before it from its predecessors, so no task orders all results.
    """
    rows = results.count()
    w = min(50, rows // 5) if rows > 20 else 5
    dealt = placed(results.select(F.col(order).alias("o"), F.col("success").cast("int").alias("s")), ["o"], rows=rows)
    placed_ = dealt.withColumn("place", F.col("place") + 1)
    block = max(w, 1000)
    own = placed_.withColumn("block", F.floor((F.col("place") - 1) / block)).withColumn("own", F.lit(True))
    lead = own.filter((F.col("place") - 1) % block >= block - w + 1).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    over = W.partitionBy("block").orderBy("place").rowsBetween(-(w - 1), 0)
    rolled = own.unionByName(lead).withColumn("rolling", F.when(F.col("place") >= w, F.avg("s").over(over)))
    return rolled.filter("own").select(F.col("o").alias(order), "place", "rolling")


def histogram(scores: DataFrame, series: str, score: str, bins: int = 15) -> DataFrame:
    """(series, bin from 1, n): equal bins between the least and the largest of all scores; the largest is in the last."""
    lo, hi = scores.agg(F.min(score), F.max(score)).first()
    if lo is None:
        return scores.select(series, F.lit(1).alias("bin"), F.lit(1).cast("long").alias("n")).limit(0)
    width = (hi - lo) / bins
    place = F.least(F.lit(bins), F.floor((F.col(score) - lo) / width) + 1) if width > 0 else F.lit(1)
    return scores.filter(F.col(score).isNotNull()).groupBy(series, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def precision_by_threshold(hits: DataFrame, score: str = "score") -> DataFrame:
    """(threshold, precision) for 0.1 to 0.9: matches among the hits that score at least that much, 0 if none does."""
    each = hits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(9))))
    over = F.col(score) >= F.col("step") / 10
    found, true = F.count(F.when(over, 1)), F.count(F.when(over & F.col("is_match"), 1))
    return each.groupBy("step").agg(F.when(found > 0, true / found).otherwise(0.0).alias("precision")).select((F.col("step") / 10).alias("threshold"), "precision")


def score_by_outcome(hits: DataFrame, results: DataFrame, score: str = "score") -> DataFrame:
    """(success, mean_score): of the first matches, and of the first hits of queries without a match."""
    joined = hits.join(results.select("query_id", "found_rank", "success"), "query_id")
    return joined.filter(F.col("rank") == F.coalesce("found_rank", F.lit(1))).groupBy("success").agg(F.avg(score).alias("mean_score"))


def compare(hits: DataFrame, config: str, score: str = "score") -> DataFrame:
    """(config, hits, queries, mean_score): one row for each configuration that was run."""
    return hits.groupBy(config).agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"), F.avg(score).alias("mean_score"))


def false_positives(results: DataFrame, impossible: str = "impossible") -> DataFrame:
    """One row: the share of questions without an answer for which one was found all the same; null if there are none."""
    return results.filter(F.col(impossible)).agg(F.avg(F.col("success").cast("int")).alias("false_positive_rate"), F.count("*").alias("n"))


def failed(results: DataFrame) -> DataFrame:
    """Questions that could have been answered and weren't."""
    could = ~F.coalesce(F.col("impossible"), F.lit(False)) if "impossible" in results.columns else F.lit(True)
    return results.filter(~F.col("success") & could)


def many_sources(results: DataFrame, sources: str = "sources") -> DataFrame:
    return results.agg(F.count_if(F.size(sources) > 1).alias("multi_source"), F.count("*").alias("n"))


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("success").agg(F.count("*").alias("n"))


def ordered(results: DataFrame) -> list:
    """The order of a report: found ones first, by rank, then the others; ties by query. For orderBy()."""
    return [F.col("success").cast("int").desc(), F.col("found_rank").asc_nulls_last(), "query_id"]


def section_of(results: DataFrame) -> F.Column:
    """The section of a report that a result belongs to."""
    impossible = F.coalesce(F.col("impossible"), F.lit(False)) if "impossible" in results.columns else F.lit(False)
    return F.when(impossible, "impossible").when(F.col("success"), "found").otherwise("not found")


def detailed(results: DataFrame, each: int = 10) -> DataFrame:
    """results (query_id, found_rank, success, retrieved; impossible, if there is such a column) with section and place, the first `each` of a section.

    Sections: 'found', 'not found' and, of questions without an answer, 'impossible'. chunk: of a found one the first that
    matches, else the best; others: up to three more of one not found, three of an impossible one.
    """
    out = results.withColumn("section", section_of(results))
    matches = F.filter("retrieved", lambda x: x["is_match"])
    out = out.withColumn("chunk", F.when(F.col("section") == "found", F.get(matches, 0)).when(F.col("section") == "not found", F.get("retrieved", 0)))
    rest = F.when(F.col("section") == "impossible", F.slice("retrieved", 1, 3)).when(F.col("section") == "not found", F.slice("retrieved", 2, 3))
    order = W.partitionBy("section").orderBy(F.col("found_rank").asc_nulls_last(), "query_id")
    return out.withColumn("others", rest).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)


def report(results: DataFrame, k: int, settings: dict[str, str] | None = None, detail: bool = False, each: int = 10) -> str:
    """A report in Markdown. It is made of aggregates, which are a few rows, and with detail of `each` results of a section."""
    could = failed(results.withColumn("success", F.lit(False)))  # all that could be answered
    m = metrics(could, k).first()
    lines = ["# Retrieval quality", "", *(f"- {name}: {value}" for name, value in (settings or {}).items())]
    lines += [f"- questions: {m.total_questions}", f"- found: {m.successful}", f"- MRR: {m.mrr:.4f}", f"- hit@1: {m.hit_at_1:.1%}", f"- hit@{k}: {m.hit_at_k:.1%}", f"- mean rank: {m.avg_position:.2f}"]
    lines += ["", "| k | accuracy | MRR |", "|-|-|-|", *(f"| {r.k} | {r.accuracy:.2%} | {r.mrr_at_k:.4f} |" for r in by_k(could, min(10, k)).orderBy("k").collect())]
    lines += ["", "| rank | questions | share |", "|-|-|-|", *(f"| {r.found_rank} | {r.n} | {r.share:.1%} |" for r in rank_distribution(could).orderBy("found_rank").collect())]
    if "impossible" in results.columns:
        r = false_positives(results).first()
        if r.n:
            lines += ["", f"- questions without an answer: {r.n}, answered all the same: {r.false_positive_rate:.1%}"]
    if "sources" in results.columns:
        r = many_sources(results).first()
        lines += [f"- questions with several sources: {r.multi_source}"] if r.multi_source else []
    if detail:
        sizes = dict(results.groupBy(section_of(results).alias("section")).count().collect())
        rows = detailed(results, each).orderBy("section", "place").collect()
        say = lambda c: ", ".join(f"{name}: {value}" for name, value in c.asDict().items())
        for section in ("found", "not found", "impossible"):
            own = [r for r in rows if r.section == section]
            lines += ["", f"## {section.capitalize()} ({len(own)} of {sizes[section]})"] if own else []
            for r in own:
                lines += ["", f"### {r.place}: query {r.query_id}" + (f", rank {r.found_rank}" if r.found_rank else "")]
                lines += [f"- {say(c)}" for c in ([r.chunk] if r.chunk else []) + (r.others or [])]
    return "\n".join(lines) + "\n"
