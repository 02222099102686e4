import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_lines string, score string, h1 int, pos int, ids string, size string, `odd name` string, _tz_id string"
TAIL = ("k", "x", "s", 1, 2, "i", "z", "o", "t")


def prose(seed, words, lang="en"):
    r = random.Random(seed)
    parts = {"en": "the of and th er in on tion ing ed be st re".split(), "de": "der die und sch ung ver en ei ch lich keit ß ü".split()}[lang]
    out = []
    for i in range(words):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
        out.append(w.capitalize() + "." if i % 11 == 10 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null ids and columns, repeated rows, a very long text, odd white space and letters, clashing names."""
    shared = "This very line stands in many documents, word for word, and is long enough."
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t\x0b\n", "en", None, 4), (4, "123 456 !!", "en", "b", 10),
        (5, prose(5, 60), "en", "b", 1), (5, prose(5, 60), "en", "b", 1), (6, prose(5, 60), "en", "a", 1), (7, prose(7, 60, "de"), "de", "c", 1),
        (None, prose(8, 40), "en", "c", 1), (None, None, None, None, None), (None, prose(9, 40) + "\n" + shared, "en", "c", 1),
        (8, prose(10, 20_000) + "\n" + shared + "\n" + shared.upper(), "en", "a", 1), (9, "Ünïcödé ΣΑΣ İ ʼn \u0085 日本語 🙂‍🙂\n" + shared, "de", "Z", 1),
        *[(20 + i, prose(100 + i, 30) + "\n  " + shared + "\t\n" + prose(200 + i, 25), "en" if i % 2 else "de", "h", 1) for i in range(6)],
        (40, "x", "en", "tiny", 1), (41, "<|endoftext|>a <|endoftext|>", "en", "tiny", 1),
    ]
    return spark.createDataFrame([(*r, *TAIL) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
