import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_line_dedup import brute as deduped
from .test_mixing import brute_targets
from .test_near_copies import survivors


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.schema == before.schema


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    letters = before.filter("text rlike '[A-Za-z]'").count()
    assert after.count() >= 0.99 * letters and not after.exceptAll(before).count()


def test_lines(stages):
    before, after = stages[1]
    want = deduped([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == [(w[0], w[3]) for w in want]
    assert not after.filter("n_chars <> length(text)").count()


def test_near_duplicates(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == survivors(rows)
    assert not after.exceptAll(before).count()


def test_mix(stages):
    before, after = stages[3]
    size = lambda t: len(t.encode().split())
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += size(r.text)
        most[r.source] = max(most[r.source], size(r.text))
    for r in after.collect():
        taken[r.source] += size(r.text)
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2


def test_encoding(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == sorted(want)


def test_run_gives_the_last_stage(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert not got.exceptAll(stages[-1][1]).count() and got.count() == stages[-1][1].count()


def test_every_stage_takes_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars", "odd name", "score", "h1", "n_lines"]
    for docs in (odd_docs.select(*cols), no_docs.select(*cols)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() >= 0 and (name == "bpe" or out.columns == cols), name


def test_language_drops_what_no_learned_language_explains(spark, sf):
    """Unlearned scripts and languages and gibberish go; short texts and mixes of learned languages stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {x: docs.filter(f"lang = '{x}' and length(text) > 300").orderBy("doc_id").first().text for x in ("de", "en", "es", "fr")}
    r = random.Random(5)
    odd = {
        -1: "人人生而自由,在尊严和权利上一律平等。" * 9, -2: "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι. " * 9, -3: "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกัน" * 9,
        -4: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 9, -5: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności. " * 9,
        -6: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)),
    }
    stay = {-11: "\n".join(clean[x] for x in ("de", "en", "es")), -12: "\n".join(clean.values()), -13: clean["fr"]}
    added = spark.createDataFrame([(i, t, None, "planted", len(t)) for i, t in (odd | stay).items()], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(added), sf).filter("doc_id < 0").collect()}
    assert got == set(stay)
