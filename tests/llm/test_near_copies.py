import random

import pytest

import corpus_pipeline
from tessera.llm import near_copies

from .test_simhash import groups


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def survivors(rows):
    """The smallest id of each group of rows (id, text), by all pairs."""
    found = [sets(t) for _, t in rows]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if like(found[i], found[j])])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


@pytest.fixture(scope="module")
def planted(spark):
    """Originals, and copies of them with 1 to 8 of 400 words changed: similarities of about 0.8 to 0.98; a chain of edits."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(400)]
        rows.append((i, " ".join(words)))
        for j in range(2):
            other = words.copy()
            for at in r.sample(range(400), 1 + (i + 4 * j) % 8):
                other[at] = word()
            rows.append((1000 + 2 * i + j, " ".join(other)))
    words = [word() for _ in range(300)]
    for i in range(40):
        rows.append((5000 + i, " ".join(words)))
        for at in r.sample(range(300), 5):
            words[at] = word()
    return rows


def test_planted_copies(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = survivors(planted)
    assert len(want) < 100 and got == want


def test_tables_and_odd_rows_against_all_pairs(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = near_copies.keep_one(docs)
    assert sorted(r.doc_id for r in out.collect()) == survivors([(r.doc_id, r.text) for r in docs.collect()]) and out.columns == docs.columns
    out = near_copies.keep_one(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    want = survivors([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None])
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 3 and out.columns == odd_docs.columns
    assert near_copies.keep_one(no_docs).count() == 0


def test_groups_of_a_repeated_id_all_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    got = near_copies.keep_one(spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, one), (1, two)]


def test_a_large_mixed_bucket_is_dealt_out(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, salt=2).collect()) == survivors(planted)


def test_one_document_in_half_the_table_and_a_dense_group(spark, planted):
    same = [(i % 3 + 9000, planted[0][1]) for i in range(400)]
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    dense = []
    for i in range(150):
        other = words.copy()
        other[r.randrange(200)] = f"x{i}"
        dense.append((20_000 + i, " ".join(other)))
    rows = planted + same + dense
    got = sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), salt=20).collect())
    assert got == survivors(rows)
