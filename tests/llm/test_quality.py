import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import quality_model, quality_rules

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times = {}
    for g in runs:
        times[g] = times.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(runs) if times[g] > 1 for k in range(5)}
    bad = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), bad


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(900, "a b c d e f a b c d e g\n\na b c d e a b c d e a b c d e"), (901, "x x x x x x x x x x x x"), (902, "one\none\n one\n \n \n"), (903, "##|<>&% *$")], "doc_id long, text string")
    for df in (odd_docs, more):
        out = quality_rules.quality_rules(df)
        rows = {(r.doc_id, r.n_words): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}
        want = [(r.doc_id, counts(r.text)) for r in df.collect()]
        assert len(out.columns) and all(rows[i, c[0]] == c for i, c in want) and out.count() == len(want)
        assert not out.filter("base_failed and kept").count()
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_base_columns_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(quality_rules.op5_counts_oracle())
    names = [d[0] for d in cur.description]
    got = quality_rules.op5_quality_rules(spark, sf)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cur.fetchall())
    assert "Python" not in got._jdf.queryExecution().toString()


def test_distance(spark):
    def plain(p, q):
        part = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return ((part(p, m) + part(q, m)) / 2) ** 0.5

    rows = [([0.5, 0.5, 0.0], [0.2, 0.3, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])]
    got = spark.createDataFrame(rows, "p array<double>, q array<double>").select(quality_rules.divergence("p", "q").alias("d")).collect()
    assert all(abs(r.d - plain(p, q)) < 1e-9 for r, (p, q) in zip(got, rows)) and abs(got[1].d - 1) < 1e-12


def test_junk_goes_and_clean_stays(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")).collect()}
    by = {q: [kept[r.doc_id] for r in rows.collect() if r.quality == q and len(r.text.split()) >= 40] for q in (0, 1)}
    assert np.mean(by[1]) > 0.97 and np.mean(by[0]) < 0.1


def test_a_fifth_language_gets_a_reference(spark):
    """Texts in a script and with words of their own are usual among their like; those of a language that few texts have are left alone."""
    r = random.Random(4)
    words = "και το να του η με για την που είναι στο από τα θα δεν στην ένα αυτό οι ότι άνθρωποι γεννιούνται ελεύθεροι ίσοι λόγος κόσμος νερό δρόμος".split()
    greek = [" ".join(r.choice(words[:20]) if r.random() < 0.4 else r.choice(words[20:]) + r.choice(words[20:]) for _ in range(150)) + "." for _ in range(40)]
    rows = [(i, t, "el") for i, t in enumerate(greek)] + [(100 + i, prose(i, 150), "en") for i in range(60)] + [(200, "слово ещё одно и потом другое " * 9 + prose(7, 30), "ru"), (201, "слово ещё одно и потом другое " * 9, None), (202, " ".join(f"q{i}zx%" for i in range(150)), "en")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), repeat_percent=100).collect()}
    assert all(got[i].kept for i in [*range(40), *range(100, 160), 200, 201]) and not got[202].kept
    assert got[200].class_distance is None and got[0].class_distance < 0.2


def test_learning_from_positives_only():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(3000, 120)), rng.normal(size=(600, 120))
    good[:, :8] += 1
    bad[:, :8] -= 1
    w, b, mean, scale = quality_model.train(good[:1500], np.concatenate([good[1500:2500], bad[:300]]), 1000 / 1300)
    z = lambda x: quality_model.standard(x, mean, scale) @ w + b
    assert np.mean(z(good[2500:]) > 0) > 0.9 and np.mean(z(bad[300:]) < 0) > 0.75


def test_risk_against_plain_sums():
    """The two parts by their definition, one text at a time, and their gradients by small steps."""
    rng = np.random.default_rng(2)
    p, u, w, b, prior = rng.normal(size=(7, 3)), rng.normal(size=(9, 3)), rng.normal(size=3), 0.3, 0.6
    loss = lambda x, w, b, y: np.log(1 + np.exp(-y * (sum(a * c for a, c in zip(x, w)) + b)))
    one = lambda w, b: prior * sum(loss(x, w, b, 1) for x in p) / len(p)
    two = lambda w, b: sum(loss(x, w, b, -1) for x in u) / len(u) - prior * sum(loss(x, w, b, -1) for x in p) / len(p)
    first, second, grad1, grad2 = quality_model.risk(w, b, p, u, prior)
    assert abs(first - one(w, b)) < 1e-12 and abs(second - two(w, b)) < 1e-12
    for f, (gw, gb) in ((one, grad1), (two, grad2)):
        for i in range(3):
            step = np.eye(3)[i] * 1e-6
            assert abs((f(w + step, b) - f(w - step, b)) / 2e-6 - gw[i]) < 1e-6
        assert abs((f(w, b + 1e-6) - f(w, b - 1e-6)) / 2e-6 - gb) < 1e-6


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        positive, unlabelled = rng.normal(2, 1, (2000, 110)), np.concatenate([rng.normal(2, 1, (n, 110)), rng.normal(-2, 1, (4000 - n, 110))])
        assert abs(quality_model.class_prior(positive, unlabelled) - share) < 0.06
    assert quality_model.class_prior(positive[:10], unlabelled[:10]) == 0.5


def test_an_id_in_half_the_table_is_drawn_once(spark):
    """What comes to the driver is bounded by the two numbers, whatever ids and texts repeat."""
    docs = spark.range(6000).selectExpr("if(id % 2 = 0, 7, id) AS doc_id", "if(id % 4 = 0, 'the same text again', concat('text number ', id, ' of many')) AS text")
    labels = spark.createDataFrame([(7, 1), (9, 1), (11, 0)], "doc_id long, quality int")
    seen = []
    keep, quality_model.train = quality_model.train, lambda p, u, prior, **_: seen.append((len(p), len(u))) or keep(p, u, prior, epochs=1)
    try:
        assert quality_model.fit(docs, labels, positives=50, unlabelled=100) is not None
    finally:
        quality_model.train = keep
    assert all(p <= 50 and u <= 100 for p, u in seen) and seen[-1][0] > 10


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_model.op6_quality(spark, sf).collect()]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    one, zero = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[a > b for b in zero] for a in one]) > 0.97


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (8, None, 1), (None, 1, 0), (4, 0, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(odd_docs, labels)
    out = quality_model.score(odd_docs, model)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert all(0 <= r.score <= 1 for r in out.collect()) and quality_model.score(no_docs, model).count() == 0
    assert quality_model.fit(odd_docs, labels.limit(0)) is None and quality_model.fit(no_docs, labels) is None
    assert {r.score for r in quality_model.score(odd_docs, None).collect()} == {0.5}
    assert quality_model.features(prose(1, 30)).shape == (quality_model.WIDTH,)


def brute_kept(rows, most=20, least_docs=20):
    """kept by plain sums, from rows (text, lang)."""
    import math
    import re
    from collections import Counter, defaultdict

    classes = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: c.islower() and not "a" <= c <= "z", lambda c: c.isalpha() and not c.islower() and not "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in ".,;:!?'\"()-"]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n, counts = Counter(lang for t, lang in rows if lang and t is not None), defaultdict(Counter)
    for t, lang in rows:
        if lang and t is not None:
            counts[lang].update(w.lower() for w in split(t))
    lists = {g: sorted(w for w, _ in counts[g].most_common(most)) for g in n if n[g] >= least_docs}
    langs = sorted(lists)

    def shares(found, total):
        return [x / total for x in [*found, total - sum(found)]]

    def away(p, q):
        part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q))))

    docs = []
    for t, lang in rows:
        w, t = split(t), t or ""
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeat = len({j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)})
        low = Counter(x.lower() for x in w)
        own = {g: sum(low[x] for x in lists[g]) for g in langs}
        best = max(langs, key=lambda g: (own[g], [-ord(c) for c in g])) if langs and max(own.values()) else None
        best = None if lang is not None and lang not in lists else best
        by = lang if lang in lists else best
        words = lambda g: shares([low[x] for x in lists[g]] + [0] * (most - len(lists[g])), len(w)) if g and len(w) >= 40 else None
        other = best if best != by else None
        docs.append((len(w) < 10 or 100 * repeat > 20 * len(w), by, other, shares([sum(map(f, t)) for f in classes], len(t)) if len(t) >= 200 else None, words(by), words(other)))
    sound = [d for d in docs if not d[0] and d[1] and d[3] and d[4]]

    def references(some):
        out = {}
        for g in {d[1] for d in some}:
            mine = [d for d in some if d[1] == g]
            out[g] = [[sum(x) / len(mine) for x in zip(*(d[k] for d in mine))] for k in (3, 4)]
        return out

    far = lambda c, w: (c is not None and c > 0.33) or (c is not None and w is not None and c + w > 0.52)
    near = lambda d, refs: (away(d[3], refs[d[1]][0]), away(d[4], refs[d[1]][1]))
    first = references(sound)
    refs = first | references([d for d in sound if not far(*near(d, first))])
    kept = []
    for failed, by, other, c, w, wo in docs:
        least = lambda pairs: min((away(p, refs[g][k]) for p, g, k in pairs if p and g in refs), default=None)
        kept.append(not failed and not far(least([(c, by, 0), (c, other, 0)]), least([(w, by, 1), (wo, other, 1)])))
    return kept


def test_kept_against_plain_sums(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")).collect()}
    want = brute_kept([(r.text, r.lang) for r in rows])
    assert [got[r.doc_id] for r in rows] == want and 0 < sum(want) < len(want)


def test_languages_cost_no_expressions(spark):
    """The plan is as long for 120 languages as for 4."""
    def plan(n):
        rows = [(i, " ".join(f"w{i % n}x{j % 25}" for j in range(60)), f"l{i % n}") for i in range(20 * n)]
        out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), repeat_percent=100)
        assert out.count() == 20 * n
        return len(out._jdf.queryExecution().analyzed().treeString().split("\n"))

    assert plan(4) == plan(120)
    with pytest.raises(ValueError):
        quality_rules.common_words(spark.createDataFrame([(f"l{i}", "a b c") for i in range(9)] * 20, "lang string, text string"), most_langs=8)
