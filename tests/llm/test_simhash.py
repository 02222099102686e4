import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.graph import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    runs = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, budget=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget]
    root = groups(len(rows), linked)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, p, least.get(r)) for (i, _), p, r in zip(rows, prints, root)), key=repr)


def test_fingerprints():
    for t in (None, "", " \n", "one", "One two\x0bthree", "a b c d", "a b c d e f g " * 9, "é Ü ß ñ À 日本 x y"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_odd_rows_against_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.id, r.fp % (1 << 64), r.component) for r in simhash.simhash_components(odd_docs).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert simhash.simhash_components(no_docs).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op2_simhash(spark, sf).collect()]
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("leaf,most", [(1, 1 << 18), (64, 1 << 18), (4, 16)])
def test_trie_against_all_pairs(leaf, most):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)]) if n else np.uint64(0) for n in rng.integers(0, 7, 400)]
    keys = np.unique(np.array([base[i % 60] ^ f for i, f in enumerate(flips)], np.uint64))
    label = simhash.trie_links(keys, np.array([0, len(keys)]), np.array([0]), np.array([-1]), 4, leaf, most)
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    want = groups(len(keys), zip(*np.nonzero(near)))
    assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


@pytest.mark.parametrize("limit,budget", [(200_000, 4), (20, 4), (1, 4), (20, 0), (20, 1), (3, 2), (5, 7)])
def test_links_with_and_without_split_nodes(spark, limit, budget):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(30)]
    prints = sorted({c ^ sum(1 << b for b in set(r.sample(range(64), r.randint(0, 5)))) for c in centres for _ in range(12)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, budget, bucket_limit=limit, rows_at_once=50).collect()]
    place = {p: i for i, p in enumerate(prints)}
    assert all((place[a] in range(len(prints))) for e in edges for a in e)
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget])
    got = groups(len(prints), [(place[a], place[b]) for a, b in edges])
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 400)] + [(500, 499), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[50] == 0 and got[499] == 100 and got[500] == 100 and 0 not in got and 7 in got and len(got) == 50 + 400
