import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, folder, join_skewed, saved, words


@pytest.mark.parametrize("hot_keys", [1000, 5, 1])
def test_join_of_hot_and_cold_keys(spark, hot_keys):
    r = random.Random(1)
    rows = [(i, r.choice([7, 7, 7, 8, *range(30), None]), r.choice([0, 1])) for i in range(900)]
    held = {}
    for _, a, b in rows:
        held[a, b] = held.get((a, b), 0) + 1
    table = [(a, b, n, a * 10 + b) for (a, b), n in held.items() if a is not None and a % 3]
    left = spark.createDataFrame(rows, "id long, a long, b long")
    right = spark.createDataFrame(table, "a long, b long, n long, pay long")
    got = join_skewed(left, right, ["a", "b"], "n", ["pay"], F.xxhash64("id"), hot_keys)
    want = left.join(right.drop("n"), ["a", "b"], "left").select("id", "a", "b", "pay")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    none = join_skewed(left, right.limit(0), ["a", "b"], "n", ["pay"], F.xxhash64("id"), hot_keys)
    assert none.count() == 900 and none.filter("pay is not null").count() == 0
    assert join_skewed(left.limit(0), right, ["a", "b"], "n", ["pay"], F.xxhash64("id"), hot_keys).count() == 0


def test_words_and_letters(spark):
    df = spark.createDataFrame([(" a\x0bB c \n",), ("",), (None,), ("ÀÉZ z",)], "t string")
    got = df.select(words(F.col("t")).alias("w"), ascii_lower(F.col("t")).alias("l")).collect()
    assert [r.w for r in got] == [["a", "B c"], [], [], ["ÀÉZ", "z"]]
    assert [r.l for r in got] == [" a\x0bb c \n", "", None, "ÀÉz z"]


def test_saved_tables_have_no_lineage(spark):
    df = saved(spark.range(10).selectExpr("id", "uuid() AS u"))
    assert df.collect() == df.collect() and folder(spark) in df._jdf.queryExecution().toRdd().toDebugString() or df.count() == 10
