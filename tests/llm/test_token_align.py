import hashlib
from collections import Counter

import public_tokenizers
import pytest

from tessera.llm import token_align as T

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a  b ", "a\n  b", "a▁b", "<|endoftext|> x <s></s>", "ééé 日本語 🙂🙂", "a" * 3000 + " b", "x　 y", "\n", " \n ", "a \n b", "a" + " " * 50 + "b", "e\u0301 ﬁ ½", "don't we'll", "a\u0085b \u2028 c",
    "tab\tand \t\t more", "x y", "x y", "x  y", "Ünï ", "0 1 2 33 4444", "\x00 a\x01",
]


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at = out[-1][1]
    return out


def brute(both, text):
    a, b = (x[0] for x in both.encode([text or ""]))
    raw = (" " + (text or "")).encode()
    if not text or b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return (0, 0, 0, ""), Counter()
    sa, sb = spans(a, both.bytes_a), spans(b, both.bytes_b)
    links = Counter((i, j) for s, e, i in sa for t, f, j in sb if s < f and t < e)
    groups, at = [], 0
    for end in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
        groups.append("|".join(",".join(str(i) for _, e, i in x if at < e <= end) for x in (sa, sb)))
        at = end
    return (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


@pytest.fixture(scope="module")
def both():
    return T.Tokenizers(*PATHS)


def want(both, rows):
    found = [brute(both, t) for _, t in rows]
    count = Counter(p for _, links in found for p in links)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (i, _), ((na, nb, g, sha), links) in zip(rows, found):
        out.append((i, na, nb, g, sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in links.items()), sha))
    return out, {(a, b): (n, n == most[a]) for (a, b), n in count.items()}


def got(out):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()]


def test_against_brute_force(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000 or text is null").select("doc_id", "text").collect()][:60]
    rows += [(10**6 + i if i % 5 else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs, pairs = T.align(df, *PATHS)
    expected, counted = want(both, rows)
    assert sorted(got(docs), key=repr) == sorted(expected, key=repr)
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == counted


def test_batches_and_what_is_remembered_change_nothing(spark, both, monkeypatch):
    texts = [f"word{i % 7} other{i} the cat\nsat {i}" for i in range(60)] + ODD
    whole = T.Aligner(both).align(texts)
    monkeypatch.setattr(T, "KNOWN", 5)
    small = T.Aligner(both)
    parts = [small.align(texts[i:i + 9]) for i in range(0, len(texts), 9)]
    assert [x for p in parts for x in p[0]] == whole[0]
    named = lambda found: [[(*map(int, (found[2].column("a")[p].as_py(), found[2].column("b")[p].as_py())), int(m)) for p, m in x.T] for x in found[1]]
    assert [x for p in parts for x in named(p)] == named(whole)
    for x in whole[1]:
        assert (T._unpack(T._pack(x), x.shape[1]) == x).all()


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    out, _ = T.align(odd_docs, *PATHS)
    assert out.count() == odd_docs.count() and set(out.columns) >= set(odd_docs.columns) - {"text"} and out.filter("n_a > 0 and n_links = 0").isEmpty()
    empty, pairs = T.align(no_docs, *PATHS)
    assert empty.count() == 0 and pairs.count() == 0
