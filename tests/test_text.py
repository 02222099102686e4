"""Text expressions against hand-computed cases and plain Python restatements."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, expr, **columns):
    names = list(columns) or ["x"]
    row = tuple(columns.values()) or ("",)
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, row))
    return spark.createDataFrame([row], kinds).select(expr.alias("y")).first().y


@pytest.mark.parametrize("text,want", [("maybe it could be", 0.5), ("Perhaps this might be it", 0.65), ("I don't know", 0.85), ("Paris is the capital.", 1.0), ("It seems it is, it was, and it will be", 0.95), ("", 1.0), ("éis wasß willing", 1.0)])
def test_confidence(spark, text, want):
    assert abs(one(spark, T.confidence(F.col("t")), t=text) - want) < 1e-9


def test_coverage(spark):
    cover = lambda a, c: one(spark, T.coverage(T.coverage_phrases(F.col("a")), F.col("c")), a=a, c=c)
    assert cover("Paris is the capital of France.", "France is big") == 1.0
    assert cover("Paris is the capital of France.", "nothing here") == 0.0
    assert cover("No claim", "x") == 1.0
    assert one(spark, T.coverage_phrases(F.col("a")), a="It was founded in 1998. It was founded in 1998! It costs 5 dollars now") == ["founded in 1998", "was founded in 1998", "5 dollars"]


def test_contribution(spark):
    def score(answer, doc):
        a, d = F.col("a"), F.col("d")
        return one(spark, T.contribution(T.attribution_phrases(a), T.significant_words(a), T.entities(a), d, T.significant_words(d), T.entities(d)), a=answer, d=doc)

    assert abs(score("Founded in 1998.", "the company was founded in 1998 in ohio") - 1.0) < 1e-9
    assert abs(score("Founded in 1998.", "started in 1998") - 0.45) < 1e-9
    assert score("Founded in 1998.", "unrelated text") == 0
    assert one(spark, T.entities(F.col("a")), a="in 1998 12% and 5 million or 3.5 dollars x1999") == ["1998", "5 million", "3.5 dollars"]


def test_overlap(spark):
    a, b = "The quick brown fox jumps over the lazy dog", "A quick brown fox jumps over a lazy dog"
    sets = lambda x, y: one(spark, T.overlap(T.token_set(F.col("x")), T.token_set(F.col("y"))), x=x, y=y)
    assert sets(a, b) == 7 / 8 and sets("", b) == 0 and sets(a, a) == 1
    score = lambda q, p: one(spark, T.keyword_score(T.token_set(F.col("q")), T.token_set(F.col("p"))), q=q, p=p)
    assert score("machine learning", "This is about machine learning algorithms") == 1 and score("", "x") == 0.5


@pytest.mark.parametrize("line,want", [("ab", False), ("12345 a", False), ("View history", False), ("A sentence with a view that goes on for more than fifty letters", True), ("Schön", True), ("interview", False)])
def test_lines(spark, line, want):
    assert one(spark, T.keep_line(F.col("t")), t=line) is want


@pytest.mark.parametrize("url,name,valid", [
    ("https://example.com:8080/path", "example.com_8080_path", True), ("https://example.com/path?query=value&other=test", "example.com_path", True),
    ("https://", "webpage", False), ("ftp://x/y", "x_y", False), ("", "webpage", False), ("no scheme", "no scheme", False),
    ("http://a/" + "b" * 200, "a_" + "b" * 98, True), ("HTTP://E.x/a|b*c", "E.x_a_b_c", True), ("http://x#f", "x", True),
])
def test_urls(spark, url, name, valid):
    assert one(spark, T.url_filename(F.col("u")), u=url) == name
    assert one(spark, T.is_url(F.col("u")), u=url) is valid


@pytest.mark.parametrize("q,reason", [
    ("What does this text say about Paris in 1999?", "contextless"), ("Where did he go after Paris?", "contextless"), ("Who is Napoleon Bonaparte exactly now?", "vague"),
    ("What year was it?", "vague"), ("which a b c d e f?", "vague"), ("According to Smith, how many ships sailed west in 1492?", "passage_reference"),
    ("How many ships sailed west from Spain in 1492?", "kept"), ("Where do the company Acme ships sail in 1492?", "kept"), ("?", "empty"), ("  ", "empty"),
    ("Where did ships sail from in 1492", "direct"),
])
def test_reject_reasons(spark, q, reason):
    passage = F.lit("The question is where did ships sail from in 1492 and why.")
    assert one(spark, T.reject_reason(T.question_text(F.col("q")), passage), q=q) == reason


def test_verdicts(spark):
    v = lambda t: tuple(one(spark, T.verdict(F.col("t")), t=t))
    assert v("Valid: No\nConfidence: 0.3\nIssues: a; b ;") == (False, 0.3, ["a", "b"])
    assert v(" Valid: yes \nConfidence: high\nIssues: None") == (True, 0.5, [])
    assert v("whatever") == (True, 0.8, [])


@pytest.mark.parametrize("t,want", [("0.7", 0.7), ("score: 85", 0.85), ("250", 1.0), ("", 0.0), ("x" * 30, 0.3), ("x" * 300, 1.0), ("1.", 1.0)])
def test_numeric_scores(spark, t, want):
    assert abs(one(spark, T.numeric_score(F.col("t")), t=t) - want) < 1e-12


@pytest.mark.parametrize("t,want", [
    ("It is so. Question: more", "It is so."), ("One. Two three", "One."), ("A—b is café. ", "Ab is caf."), ("Yes... no", "Yes"), ("Fine. Thank you all. ``` code", "Fine."), ("Made in America. Good.", "Made in"), ("", ""),
])
def test_cleaned_answers(spark, t, want):
    assert one(spark, T.cleaned_answer(F.col("t")), t=t) == want


def test_fallback_questions(spark):
    ask = lambda t: one(spark, T.fallback_question(F.col("t")), t=t)
    assert ask("So Paris met London.") == "How does this text relate Paris to London?"
    assert ask("it was Paris.") == "What does this text say about Paris?"
    assert ask("short. a longer sentence that is cut at thirty. no") == "What is the main point about a longer sentence that is cut ...?"


def test_sentences_and_preview(spark):
    assert one(spark, T.sentences_after(F.col("t")), t="A b.  C d! E?\nF") == ["A b.", "C d!", "E?", "F"]
    assert one(spark, T.preview(F.col("t"), 3), t="a\nbcd") == "a b..." and one(spark, T.preview(F.col("t"), 9), t="a") == "a"
    assert one(spark, T.clean(F.col("t")), t=" a \n\n b c ") == re.sub(r"\s+", " ", " a \n\n b c ").strip()
