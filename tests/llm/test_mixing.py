import numpy as np

from tessera.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    left = share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        give = left - sum(most * sizes[s] for s in full)
        for s in rest:
            target[s] = give * w[s] / total
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
        target.update({s: most * sizes[s] for s in over})


def test_targets_by_hand(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, "Z": 40, None: 300, "é": 0, "z": 70}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_pivot_keeps_the_sum_and_the_mean():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 200).astype(float)
    seen = np.zeros(200)
    for t in range(300):
        p = np.full(200, 0.37)
        left = mixing.pivot(p, size, np.random.default_rng(t))
        assert abs((p * size).sum() - 0.37 * size.sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != left)
        seen += p
    assert abs(seen.mean() / 300 - 0.37) < 0.02 and np.abs(seen / 300 - 0.37).max() < 0.15


def test_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(out.columns) and "target" in out.columns
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.copies <= 2
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).columns == no_docs.columns


def test_many_buckets_and_reruns(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 as int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    run = lambda d: {r.doc_id: r.copies for r in mixing.mix(d, carry=["doc_id"], bucket_rows=50, fan=4).collect()}
    first = run(df)
    assert first == run(df.repartition(7)) and len(first) == 3000
    rows = mixing.mix(df, carry=["doc_id", "source"], bucket_rows=50, fan=4).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 37
    took = mixing.take(df, bucket_rows=50, fan=4)
    assert took.count() == sum(first.values()) and took.columns == df.columns


def test_repeated_rows_move_a_source_by_one_row_at_most(spark):
    """3000 rows alike in a source of 40,000 words: each copy is taken on its own; they are spelt out again in parts."""
    df = spark.range(4000).selectExpr("if(id < 3000, 1, id) AS doc_id", "repeat('w ', if(id < 3000, 10, 11)) AS text", "if(id < 3900, 'a', 'b') AS source", "map('k', if(id < 2000, 1, 2)) AS m")
    for at_once in (10_000, 700):
        rows = mixing.mix(df, at_once=at_once).collect()
        assert len(rows) == 4000
        for s in ("a", "b"):
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 11 and max(r.copies for r in own) <= 2
        assert sum(r.doc_id == 1 for r in rows) == 3000 and sum(r.m["k"] == 1 for r in rows) == 2000
    assert mixing.take(df).count() == sum(r.copies for r in rows)
