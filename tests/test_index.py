import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.index import VectorIndex


def rows(r, n, clustered, first=0):
    if clustered:
        middles = r.normal(size=(20, 16)) * 10
        x = middles[r.integers(0, 20, n)] + r.normal(size=(n, 16))
    else:
        x = r.normal(size=(n, 16))
    return [(first + i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["l2sq", "cosine_distance"])
@pytest.mark.parametrize("clustered", [True, False])
def test_same_as_all_products(spark, tmp_path, kind, clustered):
    r = np.random.default_rng(3)
    given = rows(r, 1500, clustered)
    given += [(5000 + i, given[7][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(given, "id long, vector array<double>")
    queries = spark.createDataFrame([*given[::50], (9001, rows(r, 1, clustered)[0][1])], "query_id long, vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "i"), kind).build(df, clusters=40)
    hits, read = index.search(queries, 10)
    want = {tuple(x) for x in S.top_k(df, queries, 10, kind).collect()}
    assert {tuple(x) for x in hits.collect()} == want and len(want) == 10 * queries.count()
    share = read.agg(F.sum("rows_met") / F.sum("rows")).first()[0]
    assert read.count() == queries.count() and (share < 0.25 if clustered else share <= 1.0)
    # rows that come later, far from all others
    more = spark.createDataFrame([(20_000 + i, (np.full(16, 30.0 + i)).tolist()) for i in range(12)], "id long, vector array<double>")
    index.add(more)
    asked = queries.unionByName(more.limit(1).withColumnRenamed("id", "query_id"))
    assert {tuple(x) for x in VectorIndex(spark, index.path, kind).search(asked, 10)[0].collect()} == {tuple(x) for x in S.top_k(df.unionByName(more), asked, 10, kind).collect()}


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (4, None)], "id long, vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "i")).build(df)
    hits, _ = index.search(spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (None, [0.0, 0.0])], "query_id long, vector array<double>"), 5)
    assert [tuple(x) for x in hits.collect()] == [(1, 1, 2, 2.0)]
    with pytest.raises(ValueError):
        index.search(df.withColumnRenamed("id", "query_id"), 0)
    with pytest.raises(ValueError):
        VectorIndex(spark, "x", "inner_product")


def test_only_met_clusters_are_read(spark, tmp_path):
    r = np.random.default_rng(1)
    df = spark.createDataFrame(rows(r, 800, True), "id long, vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "i")).build(df, clusters=20)
    met = index._meet(spark.createDataFrame([(1, [0.0] * 16, 3)], "query_id long, vector array<double>, cluster int"), [3], {3: 10}, 2, True)
    assert "PartitionFilters: [isnotnull(cluster" in met._jdf.queryExecution().toString() or "cluster#" in met._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
