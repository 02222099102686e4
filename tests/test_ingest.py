import hashlib
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import ingest as I
from tessera.operators import pages as P
from tessera.operators import questions as Q
from tessera.plans.answer import Setting, answer, compare, with_and_without, with_models, with_sizes
from tessera.plans.queries import QUERIES, SQL
from tessera.sources import models as M
from tessera.sources import readers as R
from tessera.sources import sinks as K
from tessera.sources.store import ChunkStore
from tessera.streaming.ingest import ingest_texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_are_bounded_and_lose_no_word(text, size, overlap):
    got = I.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in got)
    assert set("".join(text.split())) == set("".join("".join(got).split()))
    words = [w for w in text.split() if len(w) <= size]
    joined = " ".join(got)
    assert all(w in joined for w in words)


def test_chunks_prefer_paragraphs_and_overlap():
    assert I.split_text("one two\n\nthree four\n\nfive", 12, 0) == ["one two", "three four", "five"]
    assert I.split_text("a b c d e f g h", 5, 3) == ["a b c", "b c d", "c d e", "d e f", "e f g", "f g h"]
    assert I.split_text("x" * 25, 10, 4) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7] or all(len(c) <= 10 for c in I.split_text("x" * 25, 10, 4))
    assert I.split_text("") == [] and I.split_text("  \n ") == []
    with pytest.raises(ValueError):
        I.split_text("x", 5, 5)


def test_chunks_of_a_batch_come_in_parts():
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aé", None, "", "b" * 9, "cd", "e"])], names=["id", "text"]).slice(0)
    cuts = lambda x, size: [p.column(0).to_pylist() for p in I.parts(x, 1, size)]
    assert cuts(b, 3) == [[0, 1, 2], [3], [4, 5]] and cuts(b, 1) == [[0], [1, 2], [3], [4], [5]] and cuts(b, 99) == [[0, 1, 2, 3, 4, 5]]
    assert cuts(b.slice(2), 9) == [[2, 3], [4, 5]] and cuts(b.slice(6), 9) == []


def test_memory_of_chunks_is_that_of_the_text():
    """A text without separators is packed character by character, with no list of them."""
    text = "x" * 1_000_000
    tracemalloc.start()
    try:
        assert len(I.split_text(text)) == 1 + -(-(len(text) - 1000) // 600)
        assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    finally:
        tracemalloc.stop()


def test_windows_and_ids(spark):
    df = spark.createDataFrame([(1, "a" * 2300), (2, "b"), (3, ""), (4, None)], "doc_id long, text string")
    got = I.chunk_windows(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks, len(r.text)) for r in got] == [(1, 0, 4, 1000), (1, 1, 4, 1000), (1, 2, 4, 1000), (1, 3, 4, 500), (2, 0, 1, 1)]
    assert df.select(I.content_id("text").alias("c")).first().c == hashlib.sha256(b"a" * 2300).hexdigest()
    assert I.chunk_recursive(df).count() == len(I.split_text("a" * 2300)) + 1


def test_dedup_and_manifest(spark):
    rows = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 5), (None, 4)], "k string, o int")
    assert sorted(((r.k, r.o) for r in I.first_wins(rows, ["k"], ["o"]).collect()), key=repr) == sorted([("x", 1), ("y", 2), (None, 4)], key=repr)
    stored = spark.createDataFrame([("y",), ("z",)], "k string")
    assert [r.k for r in I.new_only(rows, stored, "k").filter("k is not null").collect()] == ["x", "x"]
    r = I.duplicate_report(rows.filter("k is not null"), "k", stored).first()
    assert (r.total, r.unique, r.duplicates, r.stored, r.added) == (3, 2, 1, 1, 1)
    files = spark.createDataFrame([("/a/f", 1.0, 2), ("/b/f", 1.0, 2), ("/c", 1.0, 2), ("/d", None, 2)], "path string, mtime double, size long")
    seen = spark.createDataFrame([("/a/f", 1.0, 2), ("/b/f", 1.0, 3), ("/d", None, 2)], "path string, mtime double, size long")
    assert sorted(r.path for r in I.changed_files(files, seen).collect()) == ["/b/f", "/c"]


def test_pages():
    body = "<p>" + "x" * 120 + "</p>"
    assert P.page_content("<title> T </title><nav>n</nav><article>a<script>s</script><div class='ad'>b</div>c</article>") == ("T", "ac")
    assert P.page_content("<div class='content'>x</div><main>y</main>") == ("Untitled", "y")
    assert P.page_content("<div id=bodyContent><div id=mw-content-text>w<span class=reference>r</span></div></div><article>a</article>")[1] == "w"
    assert P.page_content(f"<body><p>short</p>{body}</body>")[1] == "x" * 120
    assert P.page_content("<body>only <b>this</b></body>")[1] == "only this" and P.page_content("")[1] == ""
    assert P.page_content("<div role=main>&eacute;&amp;</div>")[1] == "é&"


def test_page_table(spark):
    df = spark.createDataFrame([(1, "<title>T</title><article>First line is here\n12 34\n\n\n\nmenu\nLast line</article>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in P.extract_pages(df).collect()}
    assert got == {1: "T\n\nFirst line is here\nLast line", 2: "Untitled\n\n"}


#: References cut short of their ';', as where a title is cut at a fixed length, and one whose name begins like another's.
CUT = "<title>{0}</title><article><p>{0} and other words</p></article>".format("Rock &amp;&amp;amp; roll &#39;s &quot &am &notit; &copy &amp")
CUT_TEXT = "Rock &&amp; roll 's &quot &am &notit; &copy &amp"


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """A folder with pages only, one cut inside a reference, and DuckDB on it."""
    sf = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame([(1, "http://x/", CUT), (2, "http://x/", "<title>a &lt; b</title><article>Plain &amp; whole</article>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{sf}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet/*.parquet')")
    return sf, con


def test_only_closed_references_are_decoded_if_asked():
    assert P.page_content(CUT, closed=True) == (CUT_TEXT, CUT_TEXT + " and other words")
    assert P.page_content("<title>a &amp</title><p>&#x41; &#66;</p>")[0] == "a &"
    assert P.closed_references("&#x41;&#66;&eacute;&&; &#; &#x; &") == "&#x41;&#66;&eacute;&amp;&amp;; &amp;#; &amp;#x; &amp;"


def test_main_text_with_cut_references_is_as_its_sql(spark, cut_pages):
    sf, con = cut_pages
    got = sorted((r.page_id, r.content) for r in QUERIES["page_main_text"](spark, sf).collect())
    assert got == sorted(con.execute(SQL["page_main_text"]).fetchall()) and got[0] == (1, CUT_TEXT + " and other words")


def test_titles_with_cut_references_are_as_their_sql(spark, cut_pages):
    sf, con = cut_pages
    got = sorted((r.page_id, r.title) for r in QUERIES["page_title"](spark, sf).collect())
    assert got == sorted(con.execute(SQL["page_title"]).fetchall()) == [(1, CUT_TEXT), (2, "a < b")]


def test_safe_titles_with_cut_references_are_as_their_sql(spark, cut_pages):
    sf, con = cut_pages
    got = sorted((r.page_id, r.safe_title) for r in QUERIES["safe_titles"](spark, sf).collect())
    assert got == sorted(con.execute(SQL["safe_titles"]).fetchall()) and got[0] == (1, "Rock amp roll s quot am notit copy amp")


#: Titles that the parser read otherwise than the SQL: none, spread over lines, with '<', other references and spaces, new letters, or long.
ODD_TITLES = [
    None, "", "<p>no title here</p>", "<title>never closed", "<title>\n Two\nlines\n</title>", "<title>Tom < Jerry</title>", "<title>a<b<c</title>", "<title>a <b>bold</b> one</title>",
    "<title>Rock&nbsp;roll &copy; &middot; caf&eacute; it&#x27;s it&#39;s &amp;lt; &#38;</title>", "<TITLE lang='en'>Upper\u3000case\u00a0</Title >x</TITLE>", "<title>\u2003one\u00a0two\u2003</title><title>second</title>",
    "<!-- <title>in a comment</title> --><title>real</title>", "<title></title><title>second</title>", "<header><title>in a header</title></header>", "<title>\u0870\U00031350\U0001df00 \U0001f600 x\u0301 \u0663</title>",
    "<title>" + "\u1100\u1161\u11a8" * 100 + "</title>", "<title>" + "\u00e9!" * 300 + "</title>", "<title>\x00a\x00</title>", "<title>- " + " " * 300 + "x</title>",
]


@pytest.mark.parametrize("name", ["safe_titles", "page_title"])
def test_odd_titles_are_as_their_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD_TITLES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(SQL[name]).fetchall()) and len(got) == len(ODD_TITLES)


@pytest.mark.parametrize("html", ["<title" * 100_000, "<title>" * 100_000, "<title>" + "</title" * 100_000])
def test_titles_left_open_are_read_once(spark, html):
    df = spark.createDataFrame([(html,)], "html string").select(P.page_title(F.col("html")))
    assert df.collect()[0][0] == ""


def test_titles_with_a_bare_less_than_are_whole():
    assert P.page_content("<title> Tom < Jerry </title><article>x</article>") == ("Tom < Jerry", "x")


def test_passages(spark):
    long = "This sentence about Paris and London in 1999 shows what many people explain well today."
    text = " ".join([long.replace("1999", str(1900 + i)) for i in range(9)])
    got = Q.passages(text)
    assert 1 <= len(got) <= 3 and all(100 <= len(p) <= 800 for p in got)
    assert Q.passages("Short.") == ["Short."] and Q.passages("") == []
    first = "Aa bb. " + "Bob met Tim and Sue in 1901 where he tells what it means to them all in the end now, and to nobody else at all ok. " + "cc dd."
    assert not any(p.startswith("Aa bb.") for p in Q.passages(first)[:1])  # a text's first sentence is no neighbour
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = Q.with_questions(Q.significant_passages(df))
    assert rows.count() == len(got) and {r.reject_reason for r in rows.collect()} <= {"contextless", "vague", "kept"}


def test_samples_are_the_same_each_time(spark):
    df = spark.range(200).selectExpr("id", "concat('s', id % 7) AS source")
    pick = lambda d: sorted(r.id for r in Q.sample_per_group(d, "source", "id", 3).collect())
    assert pick(df) == pick(df.repartition(5)) and len(pick(df)) == 21
    assert Q.sample_groups(df, "source", "id", 4).count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello there\nyou")
    (tmp_path / "in" / "b.PDF").write_bytes(b"%PDF-" + b"x" * 1000)
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "in" / "d.xyz").write_text("no")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "e.txt").write_text("deeper")
    at = str(tmp_path / "in")
    assert [r.text for r in R.texts(spark, at + "/*.txt").collect()] == ["Hello there\nyou"]
    assert sorted(r.path.split("/")[-1] for r in R.files(spark, at).collect()) == ["a.txt", "b.PDF", "c.pdf"]
    assert {r.path.split("/")[-1]: r.valid for r in R.pdf_health(spark, at).collect()} == {"b.PDF": True, "c.pdf": False}
    assert tuple(R.health_counts(R.pdf_health(spark, at, None)).first()) == (1, 1)

    def parse(path, content):
        if path.endswith("xyz"):
            raise ValueError("bad")
        return content.decode(errors="replace")[:5]

    got = {r.path.split("/")[-1]: (r.text, r.error) for r in R.parsed_files(spark, at, parse).collect()}
    assert got["a.txt"] == ("Hello", None) and got["d.xyz"] == (None, "ValueError: bad")
    kinds = spark.createDataFrame([("http://x/y",), ("a.TXT",), ("b.pdf",), ("c.mp3",), ("z",)], "p string").select(R.kind_of(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["url", "text", "pdf", "media", "unknown"]
    (tmp_path / "q.json").write_text('[{"question": "Q?", "sources": ["a"], "chunk_index": 1}]')
    assert R.questions(spark, str(tmp_path / "q.json")).first().sources == ["a"]
    m = R.manifest(spark, str(tmp_path / "manifest"))
    assert m.count() == 0
    K.write_manifest(R.files(spark, at), str(tmp_path / "manifest"))
    K.write_manifest(R.manifest(spark, str(tmp_path / "manifest")), str(tmp_path / "manifest"))
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["v2"]
    (tmp_path / "manifest" / "v3").mkdir()  # a version that a crash left half-written
    assert R.manifest(spark, str(tmp_path / "manifest")).count() == 3
    assert I.changed_files(R.files(spark, at), R.manifest(spark, str(tmp_path / "manifest"))).count() == 0


def pdf(pages, info=b"", lang=b""):
    """A small PDF file of pages with their instructions."""
    n = len(pages)
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R " + lang + b" >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(n)) + b"] /Count %d >>\nendobj\n" % n
    for i, (content, packed) in enumerate(pages):
        import zlib

        data, how = (zlib.compress(content), b"/Filter /FlateDecode ") if packed else (content, b"")
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (10 + i, 50 + i, 50 + i, how, len(data), data)
    return out + b"3 0 obj\n<< " + info + b" >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF"


def test_pdf_files(spark, tmp_path):
    from tessera.sources import pdf as P2

    one = (b"BT /F1 12 Tf 10 700 Td (First \\(page\\) of it) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line \\351)] TJ ET", True)
    two = (b"BT <48656C6C6F> Tj T* (there) ' ET", False)
    whole = pdf([one, two], b"/Author (Ann B.) /Title <FEFF00E90041> /Producer (x)", b"/Lang (en)")
    pages, about = P2.read(whole)
    assert pages == ["First (page) of it\nSecond line é", "Hello\nthere"]
    assert about == {"author": "Ann B.", "title": "éA", "language": "en", "total_pages": "2"}
    for bad in (b"", b"x", b"%PDF-1.4 trailer << /Encrypt 9 0 R >>"):
        with pytest.raises(ValueError):
            P2.read(bad)
    (tmp_path / "a.pdf").write_bytes(whole)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(pdf([(b"BT (x) Tj ET", False)]))
    got = {r.path.split("/")[-1]: r for r in R.pdf_texts(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].text == "\n".join(pages) and got["a.pdf"].extra["author"] == "Ann B." and got["b.pdf"].error == "ValueError: not a PDF file" and got["b.pdf"].text is None
    health = {r.path.split("/")[-1]: (r.valid, r.pages) for r in R.pdf_health(spark, str(tmp_path)).collect()}
    assert health == {"a.pdf": (True, 2), "b.pdf": (False, None), "c.pdf": (False, 1)}


def test_transcripts_are_used_again(spark, tmp_path):
    at = str(tmp_path / "t")
    asked = []

    def extract(files):
        rows = files.collect()
        asked.append(sorted(r.path for r in rows))
        return spark.createDataFrame([(r.path, f"text of {r.path} {r.size}") for r in rows], "path string, text string")

    files = lambda size: spark.createDataFrame([("/x/a", 1.0, 5), ("/y/a", 1.0, size)], "path string, mtime double, size long")
    for size in (7, 7, 8):
        texts, fresh = R.through_cache(files(size), R.transcripts(spark, at), extract)
        assert {r.path: r.text for r in texts.collect()} == {"/x/a": "text of /x/a 5", "/y/a": f"text of /y/a {size}"}
        K.write_transcripts(fresh, at)
    assert asked[0] == ["/x/a", "/y/a"] and asked[-1] == ["/y/a"] and R.transcripts(spark, at).count() == 3


def test_rounds_and_errors(spark):
    found = spark.createDataFrame([(1, 0, "One passage."), (1, 1, "Two passages."), (2, 0, "Lone passage.")], "doc_id int, passage_index int, passage string")
    told = lambda p, n: F.when(n != 1, F.concat(F.lit("Which harbour does the traveller number "), n.cast("string"), F.lit(" reach at last in the evening")))
    got = [(r.doc_id, r.attempt, r.passage) for r in Q.rounds(found, "doc_id", told, 2).orderBy("doc_id", "attempt").collect()]
    assert got == [(1, 0, "One passage."), (1, 2, "One passage."), (2, 0, "Lone passage.")]
    failed = spark.createDataFrame([(1, "q", "E: x"), (2, None, "E")], "query_id int, question string, error string")
    assert [r.json for r in K.error_json(failed).orderBy("query_id").collect()] == ['{"error":"E: x","query":"q"}', '{"error":"E","query":"unknown"}']


def test_entities_as_they_were_meant(spark):
    from tessera.functions import text as T

    row = spark.sql("SELECT 'In March 5, 2020 Ada Lovelace had 12% and 3 million' AS t")
    assert row.select(T.entities(F.col("t")).alias("e")).first().e == ["2020", "3 million"]
    assert sorted(row.select(T.entities(F.col("t"), "fixed").alias("e")).first().e) == ["12%", "2020", "3 million", "ada lovelace", "in march", "march 5, 2020"]


def test_models(spark):
    assert {r.name: r.dimension for r in M.registry(spark).collect()}["text-embedding-3-large"] == 3072
    cost = spark.sql("SELECT 5000 AS t, 0.0001D AS c").select(M.embedding_cost(F.col("t"), F.col("c")).alias("x")).first().x
    assert abs(cost - 0.0005) < 1e-12
    sizes = spark.createDataFrame([("gemma-3-1b",), ("qwen-14B",), ("llama-7b",), ("x",)], "n string").select(M.model_billions(F.col("n")).alias("b")).collect()
    assert [r.b for r in sizes] == [1.0, 14.0 if sizes[1].b == 14.0 else 4.0, 7.0, 1.0]
    assert M.similar_models("llama big", ["llama3", "phi", "x"]) == ["llama3"] and M.similar_models("zz", ["phi3", "phi4", "phi5"]) == ["phi3", "phi4"]


def test_store_stream_and_answers(spark, tmp_path):
    store, model = ChunkStore(spark, str(tmp_path / "store")), M.HashingEmbedder(32)
    assert store.chunks().count() == 0 and store.embedding_model() is None
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "one.txt").write_text("The harbour of Genoa was built in 1200. It is large. " + "Ships sail. " * 60)
    (folder / "two.txt").write_text("Cheese is made from milk. It was known in 1500. " + "Cows eat grass. " * 60)
    run = lambda: ingest_texts(spark, str(folder), store, "notes", model, str(tmp_path / "check"), 200, 40).awaitTermination()
    run()
    n = store.chunks("notes").count()
    assert n > 4 and store.embedding_model("notes") == "HashingEmbedder"
    run()
    assert store.chunks().count() == n
    (folder / "three.txt").write_text((folder / "two.txt").read_text())
    run()
    assert store.chunks().count() == n  # the same chunks under another name
    assert [(r.collection, r.chunks, r.sources) for r in store.collections().collect()] == [("notes", n, 3)]

    asked = spark.createDataFrame([(1, "When was the harbour of Genoa built?"), (2, "zzz qqq")], "query_id long, question string")
    got = {r.query_id: r for r in answer(store, asked, model, M.ExtractiveGenerator(), k=3, window=1).collect()}
    assert "Genoa was built in 1200" in got[1].answer and got[1].valid and got[1].final_answer == got[1].answer
    assert any("one.txt" in x.source for x in got[1].references) and got[2].final_answer == "I don't know" and got[2].references is None
    base = Setting("base", model, M.ExtractiveGenerator(), k=3, window=1)
    many = with_models(base, {"one": M.ExtractiveGenerator(), "two": M.Fallback(M.ExtractiveGenerator())}) + with_and_without(base, M.KeywordReranker()) + with_sizes(Setting("x", model, M.ExtractiveGenerator(), reranker=M.KeywordReranker()), "k=3:kk=1, k=2")
    said = {(r.config, r.query_id): r.final_answer for r in compare(store, asked, many).collect()}
    assert {c for c, _ in said} == {"one", "two", "without reranking", "with reranking", "k=3, kk=1", "k=2"} and len(said) == 12
    assert all("Genoa" in a for (_, q), a in said.items() if q == 1)
    lines = K.answer_json(spark.createDataFrame([r for r in got.values() if r.references]), "cosine_distance", 40).collect()
    assert '"total_references"' in lines[0].json and '"similarity"' in lines[0].json


def test_rerankers_report_what_fails(spark):
    class Fails:
        def score(self, pairs):
            if any("bad" in t for _, t in pairs):
                raise ValueError("no")
            return [1.0] * len(pairs)

    df = spark.createDataFrame([("a b", "a x"), ("", "y"), ("q", "bad")], "question string, text string")
    assert [r.rerank_score for r in M.score_pairs(df, M.KeywordReranker()).collect()] == [0.5, 0.5, 0.0]
    got = {r.text: (r.rerank_score, r.error) for r in M.score_pairs(df, Fails(), on_error=0.5).collect()}
    assert got["bad"] == (0.5, "ValueError: no") and got["y"] == (1.0, None)
    hits = spark.createDataFrame([(1, "q", "bad", 0.7), (1, "q", "x", 0.2), (2, "q", "y", 0.1)], "query_id int, question string, text string, score double")
    by = lambda how: {r.text: r.rerank_score for r in M.score_pairs(hits, Fails(), on_error=how).collect()}
    assert by("keep_score") == {"bad": 0.7, "x": 1.0, "y": 1.0} and by("keep_order") == {"bad": 0.0, "x": 0.0, "y": 1.0}
    with pytest.raises(ValueError):
        M.score_pairs(hits, Fails(), on_error="other")


def test_models_by_name_and_in_turn():
    assert isinstance(M.reranker("keyword"), M.KeywordReranker)
    with pytest.raises(ValueError):
        M.reranker("keyword rerank")
    said = M.reranker("model", say=lambda prompt: "85 of 100" if "good" in prompt else "0.25" if "some" in prompt else "no")
    assert said.score([("q", "good"), ("q", "some"), ("q", "x")]) == [0.85, 0.25, 0.02]

    class Down:
        def generate(self, question, context):
            raise OSError("down")

    class Mute:
        def generate(self, question, context):
            return "  "

    assert M.Fallback(Down(), Mute(), M.ExtractiveGenerator()).generate("what is a cat", "A cat is small.") == "A cat is small."
    with pytest.raises(RuntimeError):
        M.Fallback(Down(), Mute()).generate("q", "c")
    assert M.probe(Down()) == (False, "generate: OSError: down") and M.probe(M.HashingEmbedder(4))[0] and M.probe(M.KeywordReranker())[0] and not M.probe(3)[0]
    assert len(M.embed_query(M.HashingEmbedder(4), "a b")) == 4


def test_settings(monkeypatch):
    from tessera.config import load

    monkeypatch.setenv("TESSERA_TOP_K", "9")
    assert load().top_k == 9 and load(top_k=3).top_k == 3 and load().chunk_size == 1000
    for bad in ({"top_k": 0}, {"top_k": -1}, {"chunk_overlap": 1000}, {"rerank_top_k": 10, "top_k": 4}):
        with pytest.raises(ValueError):
            load(**bad)
    with pytest.raises(TypeError):
        load(other=1)


def test_stores(spark, tmp_path):
    from tessera.sources.store import open_store

    store = open_store("parquet", spark, str(tmp_path / "s"))
    assert store.problems() == ["the store is empty"]
    rows = spark.createDataFrame([("d1", "s", 0, 2, "t", [1.0, 2.0]), ("d2", "s", 1, 2, "u", [1.0, 0.0]), ("d1", "r", 0, 1, "t", [1.0, 2.0])], "doc_id string, source string, chunk_index int, total_chunks int, text string, vector array<float>")
    assert store.add(rows, "c", "m", 2) == {"given": 3, "duplicates": 1, "stored": 0, "added": 2}
    assert store.add(rows, "c", "m", 2)["added"] == 0 and store.problems(2) == [] and len(store.problems(3)) == 1
    assert store.chunk("s", 1).first().text == "u" and store.describe().first().embedding_model == "m"
    asks = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<float>")
    assert [r.text for r in store.search(asks, 2).orderBy("rank").collect()] == ["u", "t"]
    with pytest.raises(ValueError):
        open_store("other", spark, "x")
    assert sorted((r.source, r.chunk_index, r.text) for r in store.occurrences("c").collect()) == [("r", 0, "t"), ("s", 0, "t"), ("s", 1, "u")]
    assert store.add(rows.filter("source = 'r'").replace("r", "q", ["source"]), "c", "m", 2)["added"] == 0 and store.occurrences().count() == 4
    hits = store.search(asks, 1).select("query_id", "rank", "collection", "doc_id", "source", "chunk_index", "total_chunks", "score")
    assert [r.source for r in store.placed(store.search(asks, 2)).filter("doc_id = 'd1'").orderBy("source").collect()] == ["q", "r", "s"] and hits.count() == 1
    assert store.missing(["c", "z"]) == ["z"] and store.search(asks, 1, collections=["c", "z"]).count() == 1
    with pytest.raises(LookupError):
        store.search(asks, 1, collections=["y", "z"])
    hosted = open_store("hosted", spark, "x")
    assert "hosted index" in hosted.problems()[0]
    with pytest.raises(NotImplementedError):
        hosted.chunks()


def test_small_expressions(spark):
    from tessera.functions import misc as X

    row = spark.sql("SELECT 'a/b.tar.gz' AS p, 'A: b/c_é-1?' AS t, map('author', 'x', 'secret', 'y', 'title', null) AS m, 1D AS y, 1D AS n, 0.1234D AS s, 'One two three four five six Seven eight nine ten eleven. no.' AS d")
    got = row.select(X.without_extension(X.base_name(F.col("p"))).alias("p"), X.safe_title(F.col("t")).alias("t"), X.kept_metadata(F.col("m")).alias("m"), X.yes_probability(F.col("y"), F.col("n")).alias("y"), X.percent(F.col("s")).alias("s"), X.distinctive_phrases(F.col("d")).alias("d"), X.check_prompt(F.col("p"), F.col("t"), F.col("d")).alias("c")).first()
    assert (got.p, got.t, got.m, got.y, got.s) == ("b.tar", "A bc_é-1", {"author": "x"}, 0.5, "12.3%")
    assert got.d == ["One two three four five six Seven eight nine ten"] and "Valid: Yes" in got.c


def _pdf(text):
    stream = f"BT /F1 12 Tf 50 700 Td ({text}) Tj ET"
    return f"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj\n4 0 obj<</Length {len(stream)}>>stream\n{stream}\nendstream endobj\n5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\ntrailer<</Root 1 0 R>>\n%%EOF".encode()


def test_versions_of_files_from_a_log_of_changes(spark, tmp_path):
    """Files are rewritten, deleted and added between runs, one of which is cut short: the store then is as one made of the last state."""
    import os

    from tessera.streaming import ingest as N

    folder, model = tmp_path / "in", M.HashingEmbedder(16)
    folder.mkdir()
    put = lambda name, text, at: ((folder / name).write_bytes(text if isinstance(text, bytes) else text.encode()), os.utime(folder / name, (at, at)))
    speech = {"media": lambda x: x.decode("ascii")}

    def run(store, log, check, fail=False):
        N.log_changes(spark, str(folder), str(tmp_path / log))
        real = store._append_new
        if fail:
            store._append_new = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut short"))
        try:
            N.ingest_versions(spark, str(folder), str(tmp_path / log), store, "c", model, str(tmp_path / check), 60, 10, speech).awaitTermination()
        except Exception:  # noqa: BLE001 - the one that is cut short
            assert fail
        store._append_new = real

    seen = lambda store: (sorted((r.source, r.chunk_index, r.total_chunks, r.text) for r in store.occurrences("c").collect()), sorted((r.doc_id, r.text, tuple(r.vector)) for r in store.chunks("c").collect()))
    store = ChunkStore(spark, str(tmp_path / "store"))
    put("a.txt", "alpha beta gamma. " * 12, 1000)
    put("b.txt", "what both say. " * 3, 1000)
    put("c.txt", "what both say. " * 3 + "and more of it here", 1000)
    put("d.pdf", _pdf("Words of a paper"), 1000)
    put("e.mp3", "spoken words", 1000)
    put("bad.pdf", b"no pdf at all", 1000)
    run(store, "log", "check")
    assert [r.source.rsplit("/", 1)[1] for r in store.failures().collect()] == ["bad.pdf"] and "Words of a paper" in {r.text for r in store.chunks("c").collect()}
    put("a.txt", "alpha beta gamma. " * 5 + "changed at the end", 2000)
    os.remove(folder / "b.txt")
    put("e.mp3", b"\xff\xfe", 2000)  # its reader fails: the version before it stays
    put("f.txt", "new here", 2000)
    run(store, "log", "check", fail=True)
    assert "new here" not in {r.text for r in store.chunks("c").collect()}
    run(store, "log", "check")
    put("f.txt", "newer here", 3000)
    put("d.pdf", _pdf("Other words of a paper"), 3000)
    run(store, "log", "check")
    run(store, "log", "check")
    assert {"spoken words", "newer here", "Other words of a paper"} <= {r.text for r in store.chunks("c").collect()} and "new here" not in {r.text for r in store.chunks("c").collect()}
    assert N.log_changes(spark, str(folder), str(tmp_path / "log")) == 0
    assert {(r.source.rsplit("/", 1)[1], r.version, r.state) for r in store.versions("c").collect()} == {("a.txt", 2, "live"), ("b.txt", 2, "gone"), ("c.txt", 1, "live"), ("d.pdf", 3, "live"), ("e.mp3", 1, "live"), ("f.txt", 3, "live")}
    put("e.mp3", "spoken words", 4000)
    run(store, "log", "check")
    fresh = ChunkStore(spark, str(tmp_path / "again"))
    run(fresh, "log2", "check2")
    assert seen(store) == seen(fresh)
    hits = store.search(spark.createDataFrame([(1, model.embed_documents(["what both say."])[0])], "query_id long, vector array<double>"), 3)
    assert all("b.txt" not in r.source for r in store.placed(hits).collect())


def test_an_increment_shuffles_no_stored_row(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    rows = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("int").alias("chunk_index"), F.lit(b).alias("total_chunks"), F.col("id").cast("string").alias("text"))
    assert store.add(rows(0, 300), "c")["added"] == 300
    ids = rows(299, 302).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(store.BUCKETS)).cast("int").alias("bucket"))
    known = store.stored_ids(ids, "c", True)
    plan = known._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan parquet")
    assert "Exchange hashpartitioning" not in plan[:scan] and "bucket" in plan[plan.index("PartitionFilters"):] and "ReadSchema: struct<doc_id:string>" in plan and known.count() == 1
    assert store.stored_ids(ids, "c", False).count() == 1
    assert store.add(rows(290, 310), "c") == {"given": 20, "duplicates": 0, "stored": 10, "added": 10} and store.chunks("c").count() == 310
    store.SMALL = 0
    assert store.add(rows(300, 320), "c")["added"] == 10 and set(store.chunks().columns) >= {"doc_id", "vector"} and "bucket" not in store.chunks().columns


def test_first_of_each_id_of_a_stream(spark, tmp_path):
    """Three batches with repeats, and a restart between them: the rows are those of the batch path."""
    from tessera.streaming import ingest as N

    N.use_rocksdb(spark)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "chunk_id string, source string, chunk_index int"
    batches = [[("a", "s", 2), ("a", "s", 1), ("b", "s", 3)], [("a", "r", 0), ("c", "r", 1), ("c", "q", 9)], [("b", "z", 0), ("d", "z", 1), ("d", "z", 1)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = N.first_wins_stream(spark.readStream.schema(schema).parquet(src), "chunk_id", ["source", "chunk_index"])
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("a", "s", 1), ("b", "s", 3), ("c", "q", 9), ("d", "z", 1)]


def _paper(fonts, content):
    """A PDF file of one page with fonts (name: (dictionary, character map))."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << " + b" ".join(b"/%s %d 0 R" % (n.encode(), 10 + 2 * i) for i, n in enumerate(fonts)) + b" >> /ProcSet [/PDF] >> >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)}
    for i, (about, to) in enumerate(fonts.values()):
        objects[10 + 2 * i] = b"<< /Type /Font " + about + (b" /ToUnicode %d 0 R" % (11 + 2 * i) if to else b"") + b" >>"
        if to:
            import zlib

            packed = zlib.compress(to)
            objects[11 + 2 * i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


MAP = b"""begincmap
1 begincodespacerange
<0000> <FFFF>
endcodespacerange
2 beginbfchar
<0001> <0048>
<0005> <00660069>
endbfchar
2 beginbfrange
<0010> <0029> <0061>
<0040> <0042> [<00E9> <0020> <D835DC00>]
endbfrange
endcmap"""


def test_fonts_by_their_character_maps():
    from tessera.sources import pdf as P2

    two = {"F1": (b"/Subtype /Type0 /Encoding /Identity-H", MAP), "F2": (b"/Subtype /Type1 /Encoding << /Differences [ 65 /fi /eacute /uni20AC /odieresis 90 /quoteright ] >>", None), "F3": (b"/Subtype /TrueType", MAP.replace(b"<0000> <FFFF>", b"<00> <FF>").replace(b"<0001> <0048>", b"<51> <004D>"))}
    content = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm <0001001400410040004200050099> Tj ET BT /F2 10 Tf 1 0 0 1 50 680 Tm (ABC DZs) Tj ET BT /F3 10 Tf 50 660 Td (Q\\020) Tj ET"
    assert P2.read(_paper(two, content))[0] == ["He \u00e9\U0001d400fi\nfi\u00e9\u20ac \u00f6\u2019s\nMa"]
    assert P2.character_map(b"")[1] == {} and P2.glyph("nothing") == "" and P2.glyph("u1F600") == "\U0001f600"


def test_lines_and_columns_by_position():
    from tessera.sources import pdf as P2

    show = lambda x, y, t: f"1 0 0 1 {x} {y} Tm ({t}) Tj ".encode()
    font = {"F1": (b"/Subtype /Type1", None)}
    # written line by line over both columns, the title last
    rows = b"".join(show(50, 600 - 14 * i, f"left {i} of the page here") + show(310, 600 - 14 * i, f"right {i} of the page") for i in range(5))
    page = P2.read(_paper(font, b"BT /F1 12 Tf " + rows + show(50, 640, "A title that goes over both of the columns of this one page") + show(50, 500, "And a foot that goes over both of its columns once again here") + b"ET"))[0][0]
    assert page.split("\n") == ["A title that goes over both of the columns of this one page", *(f"left {i} of the page here" for i in range(5)), *(f"right {i} of the page" for i in range(5)), "And a foot that goes over both of its columns once again here"]
    # lines out of order, and one of several pieces
    page = P2.read(_paper(font, b"BT /F1 12 Tf " + show(50, 100, "third") + show(50, 128, "first") + show(82, 128.5, "line") + show(50, 114, "second") + b"ET"))[0][0]
    assert page == "first line\nsecond\nthird"
