import random

from tessera.llm import license_scan as L


def brute(text):
    w, starts, labels = L.template_words(text or ""), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "cc by cc by CC-BY cc. by cc by", "MIT License mit  license\nGNU General\tPublic-License MIT LICENSE", "éMIT license mit licenseé", "", None, "gnu general public", "x " * 30 + "Released under the MIT License. " + "y " * 30 + "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Licensed under words CC and BY other NC words 4 far 0 apart", "mit " * 4000 + "license",
]


def test_against_brute_force(spark, odd_docs, no_docs):
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    for d in (df, odd_docs):
        out = L.license_scan(d)
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect()), key=repr)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in d.collect()), key=repr)
        assert all(0 <= r.score <= 1 for r in out.collect()) and "Python" not in out._jdf.queryExecution().toString()
    assert L.license_scan(no_docs).count() == 0


def test_voted_labels_and_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.license_scan(df).collect()}
    assert got[0].labels == "apache,apache-2.0" and got[0].score == 1 and (got[0].spans[0].first_word, got[0].spans[0].last_word) == (0, 7)
    assert [(s.label, s.first_word, s.last_word) for s in got[7].spans] == [("mit", 30, 34), ("mit", 65, 69)]
    assert got[8].labels == "mit" and got[8].n_base == 0 and 0.6 <= got[8].score < 1  # one word changed, one put in
    assert got[9].labels == "" and got[9].score == 0 and got[2].score == 0.5


def voted(text, k=4, min_votes=0.3, min_share=0.7):
    """The spans by their rules, word by word: (label, first, last, share)."""
    w = L.template_words(text or "")
    found = []
    for t, (label, said) in enumerate(L.TEMPLATES):
        tw = L.template_words(said)
        runs = len(tw) - k + 1
        votes = {}
        for p in range(len(w) - k + 1):
            for q in range(runs):
                if w[p:p + k] == tw[q:q + k]:
                    votes.setdefault(p - q, []).append((p, q))
        bands, slack = [], max(2, len(tw) // 8)
        for d in sorted(votes):
            if bands and d - bands[-1][-1] <= slack:
                bands[-1].append(d)
            else:
                bands.append([d])
        parts = []
        for ds in bands:
            ps = [p for d in ds for p, _ in votes[d]]
            parts += [ds] if max(ps) + k - min(ps) <= 1.25 * len(tw) + slack else [[d] for d in ds]
        for ds in parts:
            at = [x for d in ds for x in votes[d]]
            same = sum(any(0 <= j + d < len(w) and w[j + d] == tw[j] for d in ds) for j in range(len(tw)))
            if len({q for _, q in at}) >= min_votes * runs and same / len(tw) >= min_share:
                found.append((same / len(tw), len(tw), -t, min(p for p, _ in at), max(p for p, _ in at) + k - 1, label))
    best = [x for x in found if not any(y[:5] > x[:5] and y[3] <= x[4] and x[3] <= y[4] for y in found)]
    return sorted({(x[5], x[3], x[4], x[0]) for x in best})


def test_votes_against_brute_force(spark, odd_docs):
    r = random.Random(1)
    texts = list(TEXTS)
    for _ in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            own = L.template_words(r.choice(L.TEMPLATES)[1])
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                at = r.randrange(len(own))
                own[at:at + r.randint(0, 1)] = [r.choice(["of", "license", "zzz", "software"])] * r.randint(0, 4)
            w += [r.choice(["x", "the", "mit", "license"])] * r.randint(0, 12) + own[r.choice([0, 0, 0, 3]):]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for d in (df, odd_docs.select("doc_id", "text")):
        for row in L.license_scan(d.withColumn("raw", d["text"])).collect():
            want = voted(row.raw)
            some += len(want)
            assert [tuple(s) for s in row.spans] == want
            assert row.labels == ",".join(sorted({s[0] for s in want} | set(brute(row.raw)[4].split(",")) - {""}))
            assert row.score == (max((s[3] for s in want), default=0.5 if brute(row.raw)[1] else 0))
    assert some > 60


def test_copies_and_repeated_rows(spark):
    """Half of all rows are one text, some with one id; each row has its result, and none is lost."""
    text = "x y z. Released under the MIT License. " * 3
    df = spark.range(4000).selectExpr("if(id < 1000, 7, id) AS doc_id", f"if(id % 2 = 0, '{text}', concat('this program is free software ', id)) AS text")
    got = L.license_scan(df, k=3).groupBy("labels", "n_base", "score").count().collect()
    assert sorted((r.labels, r.n_base, r["count"]) for r in got) == [("", 0, 2000), ("mit", 3, 2000)]


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame([(i, "before it " + t + " after it") for i, (_, t) in enumerate(L.TEMPLATES)], "doc_id long, text string")
    for r in L.license_scan(df).collect():
        assert L.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op8_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]) for r in rows)


def test_many_notices_in_one_text_take_time_that_grows_with_it(spark):
    import time

    one = "Released under the MIT License. and then Licensed under the Apache License, Version 2.0. x y z "
    took = []
    for n in (500, 20_000):
        began = time.monotonic()
        row = L.license_scan(spark.createDataFrame([(1, one * n)], "doc_id long, text string")).first()
        took.append(time.monotonic() - began)
        assert len(row.spans) == 2 * n and row.n_base == 2 * n and row.spans[0].first_word == 7
    assert took[1] < 40


def test_spans_as_by_all_pairs(spark):
    import random

    r = random.Random(3)
    texts = []
    for _ in range(30):
        parts = [r.choice(["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", L.TEMPLATES[1][1], L.TEMPLATES[2][1], "foo bar", "licensed under the"]) for _ in range(12)]
        texts.append(" ".join(parts))
    for row in L.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        w = L.template_words(texts[row.doc_id])
        spans = [(s.label, s.first_word, s.last_word, s.share) for s in row.spans]
        assert spans == sorted(set(spans))
        for a in spans:  # no span overlaps one that is surer
            assert not any(a[1] <= b[2] and b[1] <= a[2] and b[3] > a[3] for b in spans)
        for i, (label, text) in enumerate(L.TEMPLATES):  # whole notices are found, unless a better one stands there
            t = L.template_words(text)
            for at in range(len(w) - len(t) + 1):
                if w[at:at + len(t)] == t and len(t) >= 4:
                    assert any(s[1] <= at + len(t) - 1 and at <= s[2] and s[3] == 1.0 for s in spans)
