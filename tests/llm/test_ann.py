import math

import numpy as np
import pytest

from tessera.llm import ann


def test_hilbert_is_a_walk_through_all_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = ann.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def brute(rows, k=20, asks=lambda i: i % 20 == 0):
    """Rows are distinct (id, vector); each asks for the nearest others of its length."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for q, v in good:
        if asks(q):
            near = sorted((-float(np.dot(np.array(v), np.array(c))), i) for i, c in good if len(c) == len(v) and (i, c) != (q, v))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(near)]
    return sorted(out)


def test_odd_rows_are_exact_on_a_small_table(spark):
    rng = np.random.default_rng(0)
    vs = rng.normal(size=(60, 6)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(i, None) for i in (200, 201)] + [(220, [0.0] * 6), (240, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (260, [math.nan] * 6), (280, [math.inf] + [1.0] * 5), (300, [1.0, 2.0]), (301, [3.0, 1.0]), (None, rows[0][1]), (20, rows[5][1]), (5, rows[5][1]), (5, rows[8][1])]
    names = "vec_id long, embedding array<double>, rank int, h1 string, u int, asks string, v int, d int, `vec_id 2` int"
    df = spark.createDataFrame([(i, v, 1, "x", 1, "y", 2, 3, 4) for i, v in rows], names)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, "vec_id % 20 = 0").collect())
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    few = ann.nearest(df.filter("vec_id < 4"), "vec_id = 0").collect()
    assert len(few) == 3


@pytest.mark.parametrize("n", [1000, 6000])
def test_structured_vectors_need_narrow_windows(spark, n):
    """Where vectors have structure, what a query meets doesn't grow with the table, and the recall holds."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 40, 32)) * 3
    vs = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 32)) * 0.3
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(vs)]
    met, keep = [], ann.window
    ann.window = lambda *a: met.append(keep(*a)) or met[-1]
    try:
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", least=16).collect()
    finally:
        ann.window = keep
    want = {(w[0], w[2]) for w in brute(rows)}
    assert len(want & {(g.query_id, g.vec_id) for g in got}) / len(want) >= 0.9 and met[0] <= 120


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), ann.op10_ann(spark, sf).collect()
    sets = lambda x: {(a[0], a[2]) for a in x}
    assert len(got) == len(want) and len(sets(want) & sets(got)) / len(want) >= 0.9
    score = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(score[g.query_id, g.vec_id] - g.score) < 1e-12 for g in got if (g.query_id, g.vec_id) in score)


def test_longer_vectors_win_by_inner_product(spark):
    rng = np.random.default_rng(1)
    vs = rng.normal(size=(1500, 8)) * rng.uniform(0.1, 3, (1500, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    want = {(w[0], w[2]) for w in brute(rows)}
    assert len(want & {(g.query_id, g.vec_id) for g in got}) / len(want) >= 0.9
