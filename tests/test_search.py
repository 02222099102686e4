import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import context as C
from tessera.operators import evaluate as E
from tessera.operators import search as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=5)], i % 3) for i in range(70)]
    rows += [(100, rows[4][1], 0), (101, rows[4][1], 1), (102, None, 1), (None, rows[0][1], 1), (103, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>, part int")


def brute(rows, ask, k, kind):
    value = {"l2sq": lambda a, b: ((a - b) ** 2).sum(), "inner_product": lambda a, b: a @ b, "cosine_distance": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "cosine_similarity": lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[kind]
    sign = 1 if V.LOWER_IS_BETTER[kind] else -1
    good = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None}
    out = []
    for q in ask:
        near = sorted((round(sign * value(good[q], v), 9), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["l2sq", "inner_product", "cosine_distance", "cosine_similarity"])
@pytest.mark.parametrize("block,lines", [(50_000, 20_000), (9, 3)])
def test_top_k(table, kind, block, lines):
    rows, df = table
    asks = df.filter("id % 7 = 0 or id in (100, 102)").select(F.col("id").alias("query_id"), "vector")
    got = S.top_k(df, asks, 6, kind, block, lines).collect()
    want = brute(rows, [i for i in range(0, 70, 7)] + [100], 6, kind)
    assert sorted((r.query_id, r["rank"], r.id) for r in got if r.query_id != 100 and r.query_id % 7 == 0) == [w for w in want if w[0] != 100]
    hundred = {r.id for r in got if r.query_id == 100}
    assert {4, 101} <= hundred if kind != "inner_product" else len(hundred) == 6


def test_more_k_begins_with_less_k(table):
    _, df = table
    asks = df.filter("id < 5").select(F.col("id").alias("query_id"), "vector")
    top = lambda k: {(r.query_id, r["rank"]): r.id for r in S.top_k(df, asks, k).collect()}
    small, large = top(3), top(12)
    assert small.items() <= large.items() and len(large) == 5 * 12
    with pytest.raises(ValueError):
        S.top_k(df, asks, 0)


def test_collections(table):
    rows, df = table
    asks = df.filter("id < 4").select(F.col("id").alias("query_id"), "vector")
    got = S.top_k(df, asks, 2, collection="part")
    for q in range(4):
        for p in range(3):
            own = [r for r in rows if r[2] == p or r[0] == q]
            assert [r.id for r in got.filter(f"query_id = {q} and part = {p}").orderBy("rank").collect()] == [w[2] for w in brute(own, [q], 2, "l2sq") if rows[w[2] if w[2] < 70 else 4][2] == p or w[2] >= 70][:2]
    merged = S.merge_collections(got, "l2sq", 3).collect()
    assert len(merged) == 12 and all(r["rank"] <= 3 for r in merged)


def test_rerank_keeps_ties_in_order(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.2), (1, 2, "b", 0.9), (1, 3, "c", 0.9)], "query_id int, rank int, id string, s double")
    got = [(r.id, r.original_rank, r.new_rank, r.direction) for r in S.rerank(hits, F.col("s")).orderBy("new_rank").collect()]
    assert got == [("b", 1, 0, "up"), ("c", 2, 1, "up"), ("a", 0, 2, "down")]
    assert S.rerank(hits, F.col("s"), 1).count() == 1


def test_sweeps():
    assert S.parse_sweep("k=5:kk=3, k=10,,k=2 : kk=2") == [("k=5, kk=3", 5, 3), ("k=10", 10, 10), ("k=2, kk=2", 2, 2)]
    assert S.parse_sweep("k=-1") == [("k=-1", -1, -1)]  # the original takes such numbers; searches refuse them
    for bad in ("5", "5=3", "k=", "kk=3", "k=5:k=3"):
        with pytest.raises(ValueError):
            S.parse_sweep(bad)


def test_collections_that_fail(spark):
    hits = spark.createDataFrame([(1, 0.5)], "query_id int, score double")
    told = []

    def one(name):
        if name == "bad":
            raise OSError("gone")
        return hits

    got = S.search_collections(["a", "bad", "b"], one, lambda n, e: told.append((n, str(e)))).collect()
    assert sorted(r.collection_name for r in got) == ["a", "b"] and told == [("bad", "gone")]
    with pytest.raises(LookupError):
        S.search_collections(["bad"], one)


def test_blocks_are_sized_by_bytes(table, monkeypatch):
    _, df = table
    asks = df.filter("id < 3").select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, S.top_k(df, asks, 4).collect()))
    monkeypatch.setattr(S, "BLOCK_BYTES", 8 * 5 * 7)
    assert sorted(map(tuple, S.top_k(df, asks, 4).collect())) == want


def test_hits_by_source_and_what_they_become(spark):
    hits = spark.createDataFrame([(1, 1, "b", 4, 20, 0.3, "h4"), (1, 2, "a", None, None, 0.1, "loose"), (1, 3, "b", 6, 20, 0.2, "h6"), (1, 4, "a", 0, 2, 0.4, "h0"), (1, 5, "c", 9, 10, 0.9, "gone")], "query_id int, rank int, source string, chunk_index int, total_chunks int, score double, text string")
    assert {(r["rank"], r.source_place, r.place_in_source) for r in C.grouped(hits).collect()} == {(1, 1, 1), (3, 1, 2), (2, 2, 1), (4, 2, 2), (5, 3, 1)}
    chunks = spark.createDataFrame([("b", i, f"b{i}") for i in range(20)] + [("a", i, f"a{i}") for i in range(2)], "source string, chunk_index int, text string")
    row = lambda r: (r.source, r.chunk_index, r.expanded_range, r.expansion_window, r.chunk_count, r.score, r.text.replace("\n\n", " "))
    wide = ("b", 2, "2-8", 7, 7, 0.2, "b2 b3 b4 b5 b6 b7 b8")
    got = [row(r) for r in C.expand_hits(hits, chunks).orderBy("place").collect()]
    assert got == [("a", None, None, None, None, 0.1, "loose"), wide, ("a", 0, "0-1", 2, 2, 0.4, "a0 a1"), ("c", 9, "7-9", 3, 0, 0.9, "gone")]
    compat = [row(r)[:3] for r in C.expand_hits(hits, chunks, compat=True).orderBy("place").collect()]
    assert compat == [("b", 2, "2-8"), ("a", None, None), ("a", 0, "0-1"), ("c", 9, "7-9")]
    assert [row(r)[5] for r in C.expand_hits(hits, chunks, lower_is_better=False).orderBy("place").collect()] == [0.9, 0.4, 0.3, 0.1]
    assert {r.score for r in C.expand_hits(hits, chunks, lower_is_better=False, compat=True).filter("source = 'b'").collect()} == {0.2}
    assert C.expand_hits(hits, chunks, 0).filter("expanded_range is null").count() == 5


def test_report(spark):
    chunk = "array<struct<rank:int,id:long,score:double,is_match:boolean>>"
    rows = [(i, (i % 4) or None, bool(i % 4), [(r, 100 * i + r, 0.1 * r, r == i % 4) for r in range(1, 5)], i == 8, ["a", "b"] if i == 1 else ["a"]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, f"query_id int, found_rank int, success boolean, retrieved {chunk}, impossible boolean, sources array<string>")
    found = E.detailed(df).orderBy("section", "place").collect()
    assert [r.found_rank for r in found if r.section == "found"] == [1] * 8 + [2] * 2 and all(r.chunk.is_match for r in found if r.section == "found")
    assert [(r.query_id, len(r.others), r.chunk.rank) for r in found if r.section == "not found"][:2] == [(4, 3, 1), (12, 3, 1)]
    assert [r.query_id for r in df.orderBy(*E.ordered(df)).limit(3).collect()] == [1, 5, 9]
    text = E.report(df, 4, {"model": "m"}, detail=True)
    assert "- model: m" in text and "## Found (10 of 23)" in text and "## Not found (6 of 6)" in text and "## Impossible (1 of 1)" in text and "several sources: 1" in text
    assert "questions: 29" in text and "answered all the same: 0.0%" in text and "### 1: query 1, rank 1" in text and "## Found" not in E.report(df, 4)


@pytest.mark.parametrize("hits,window,total,want", [([4, 6], 2, 20, [(2, 8)]), ([2, 7], 2, 20, [(0, 9)]), ([2, 8], 2, 20, [(0, 4), (6, 10)]), ([0], 2, 2, [(0, 1)]), ([0, 19], 3, 20, [(0, 3), (16, 19)])])
def test_ranges(spark, hits, window, total, want):
    df = spark.createDataFrame([("s", h, total, float(h)) for h in hits], "source string, chunk_index int, total_chunks int, score double")
    got = C.merge_ranges(C.neighbours(df, window), ["source"])
    assert sorted((r.start, r.end) for r in got.collect()) == want
    high = C.merge_ranges(C.neighbours(df, window), ["source"], lower_is_better=False)
    assert max(r.score for r in high.collect()) == max(hits) and min(r.score for r in got.collect()) == min(hits)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6)), min_size=1, max_size=25))
def test_merged_ranges_are_apart_and_cover_the_same(spark, ranges):
    df = spark.createDataFrame([("s", a, a + n, 0.0) for a, n in ranges], "source string, start int, end int, score double")
    got = sorted((r.start, r.end) for r in C.merge_ranges(df, ["source"]).collect())
    cover = lambda rs: {x for a, b in rs for x in range(a, b + 1)}
    assert cover(got) == cover((a, a + n) for a, n in ranges)
    assert all(a[1] + 1 < b[0] for a, b in zip(got, got[1:]))


def test_expansion(spark):
    chunks = spark.createDataFrame([("s", i, f"t{i}") for i in (0, 1, 3)] + [("r", 0, "x")], "source string, chunk_index int, text string")
    ranges = spark.createDataFrame([("s", 0, 3, 0.5), ("s", 7, 9, 0.1)], "source string, start int, end int, score double")
    got = {r.start: (r.text, r.first_chunk, r.chunk_count) for r in C.expand(ranges, chunks, ["source"]).collect()}
    assert got == {0: ("t0\n\nt1\n\nt3", 0, 3), 7: ("", None, 0)}
    assert [tuple(r) for r in C.sizes(C.expand(ranges, chunks, ["source"]), ["source"]).collect()] == [("s", 2, 10, 5)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, None, False)], "query_id int, found_rank int, success boolean")
    m = E.metrics(df, 2).first()
    assert (m.mrr, m.hit_at_1, m.hit_at_k, m.avg_position, m.total_questions, m.successful) == (0.5, 1 / 3, 2 / 3, 1.5, 3, 2)
    assert {r.k: r.mrr_at_k for r in E.by_k(df, 2).collect()} == {1: 1 / 3, 2: 0.5}
    none = E.metrics(df.filter("not success"), 2).first()
    assert none.mrr == 0 and none.avg_position == float("inf")
    assert "MRR: 0.5000" in E.report(df, 2) and {r.found_rank: r.share for r in E.rank_distribution(df).collect()} == {1: 0.5, 2: 0.5}


@pytest.mark.parametrize("n", [3, 25, 2600])
def test_rolling(spark, n):
    s = [(i * 7) % 5 < 2 for i in range(n)]
    df = spark.createDataFrame([(i * 3, x) for i, x in enumerate(s)], "query_id int, success boolean").repartition(3)
    w = min(50, n // 5) if n > 20 else 5
    got = [r.rolling for r in E.rolling_success(df).orderBy("query_id").collect()]
    want = [None if i + 1 < w else sum(s[i + 1 - w:i + 1]) / w for i in range(n)]
    assert len(got) == n and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(got, want))


def test_histogram_and_thresholds(spark):
    hits = spark.createDataFrame([(1, i / 20, i % 2 == 0) for i in range(21)], "query_id int, score double, is_match boolean")
    h = E.histogram(hits, "is_match", "score", 4).collect()
    assert sum(r.n for r in h) == 21 and {r.bin for r in h} == {1, 2, 3, 4}
    assert E.histogram(hits.limit(0), "is_match", "score").count() == 0 and E.histogram(hits.limit(1), "is_match", "score").first().bin == 1
    p = {round(r.threshold, 1): r.precision for r in E.precision_by_threshold(hits).collect()}
    assert p[0.9] == 2 / 3 and len(p) == 9


def test_verdicts_and_impossible_questions(spark):
    from tessera.plans.answer import validated

    rows = [("Paris is the capital.", "the capital is paris", "Valid: No"), ("Paris is the capital.", "the capital is paris", None), ("Paris is the capital.", "the capital is paris", "Valid: Yes")]
    got = validated(spark.createDataFrame(rows, "answer string, context string, reply string"), "reply").collect()
    assert [r.final_answer for r in got] == ["I don't know", "Paris is the capital.", "Paris is the capital."]
    df = spark.createDataFrame([(1, 1, True, False), (2, None, False, True), (3, None, False, None), (4, 1, True, True)], "query_id int, found_rank int, success boolean, impossible boolean")
    assert E.possible_metrics(df, 4).first().success_rate == 0.5 and [r.query_id for r in E.failed(df).collect()] == [3]
    r = E.false_positives(df).first()
    assert (r.false_positive_rate, r.n) == (0.5, 2)


def test_ranges_of_a_hot_source_are_merged_by_segments(spark):
    r = random.Random(3)
    rows = [(s, a, a + r.choice([0, 1, 2, 5, 40]), r.random()) for s in ("hot", None) for a in (r.randrange(-20, 900) for _ in range(300))] + [("one", 5, 2000, 0.5), ("one", 2001, 2001, 0.1), ("one", 2003, 2003, 0.2)]
    df = spark.createDataFrame(rows, "source string, start int, end int, score double")
    ones = df.withColumn("hits", F.lit(1).cast("long"))
    for better, best in ((True, F.min("score")), (False, F.max("score"))):
        want = sorted(map(tuple, C._islands(ones, ["source"], best).collect()), key=repr)
        for segment in (1, 7, 64, 10_000):
            assert sorted(map(tuple, C.merge_ranges(df, ["source"], better, segment=segment).collect()), key=repr) == want
    long = spark.range(200_000).select(F.lit("s").alias("source"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.col("id") % 3).alias("end"), F.lit(1.0).alias("score"))
    merged = C.merge_ranges(long, ["source"])
    assert merged.count() == 200_000 - 200_000 // 3 and merged.agg(F.sum("hits")).first()[0] == 200_000


def test_long_sources_are_expanded_by_bins(spark):
    chunks = spark.range(3000).filter("id % 11 <> 5").select(F.lit("s").alias("source"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("t"), "id").alias("text"))
    ranges = spark.createDataFrame([("s", a, a + n, 0.5) for a, n in ((0, 4), (250, 10), (255, 0), (0, 2999), (5, 0), (2998, 400), (5000, 3))] + [("other", 1, 2, 0.5)], "source string, start int, end int, score double")
    want = {tuple(r) for r in C.expand(ranges, chunks, ["source"], bin_size=10_000).collect()}
    assert {tuple(r) for r in C.expand(ranges, chunks, ["source"]).collect()} == want == {tuple(r) for r in C.expand(ranges, chunks, ["source"], bin_size=7).collect()} and len(want) == 8
