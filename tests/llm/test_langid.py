import numpy as np
import pytest

from tessera.llm import langid

from .conftest import prose


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(i, 80, x), x) for i in range(60) for x in [("en", "de")[i % 2]]] + [(900 + i, "это русский текст и ещё слова " * 3, "ru") for i in range(6)] + [(990, None, "en"), (991, "x", None)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_known_languages_and_spans(model):
    assert model.langs == ["de", "en", "ru"]
    en, de = prose(1001, 40), prose(1002, 40, "de")
    got = model.label([en, de, en + " " + de + " " + de, "русский", "123 !?", "", None, "½ ² ①"])
    assert [g[0] for g in got] == ["en", "de", "de", "ru", "und", "und", "und", "und"]
    assert all(0 <= g[1] <= 1 for g in got) and got[4][1] == 0
    spans = got[2][2]
    assert spans[0][0] == 0 and [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - 39) <= 2
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_script_narrows(model):
    assert model.scripts["Cyrillic"].tolist() == [False, False, True]
    assert model.label(["слово"])[0][0] == "ru"


def test_viterbi_against_brute_force(model):
    """The labels' score is the best of all sequences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        m = rng.normal(size=(n, 3)).astype(np.float32) * 5
        value = lambda p: sum(float(m[i, x]) for i, x in enumerate(p)) - model.switch * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=n)))
        path = model.paths([m, m[:1]])[0]
        assert abs(value(path) - best) < 1e-4


def test_memory_of_words_is_bounded(model):
    small = langid.Model(model.langs, model.index, model.begin, model.of, model.more, model.base, model.scripts, model.usual, limit=50)
    small.limit = 50
    texts = [prose(i, 400) for i in range(4)]
    assert [x[0] for x in small.label(texts)] == [x[0] for x in model.label(texts)] and len(small.known) <= 50


def test_odd_rows(spark, odd_docs, no_docs, model):
    out = langid.identify(odd_docs, model)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns) and dict(out.dtypes)["score"] == "double"
    assert {r.lang_pred for r in out.filter("text is null or doc_id in (2, 3, 4)").collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
    none = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_a_run_of_letters_is_read_whole(model):
    """A text that lost its spaces goes by all its letters, not by its first 64."""
    title, body = prose(1, 30).replace(" ", "").replace(".", "")[:64], prose(2, 900, "de").replace(" ", "").replace(".", "")
    (lang, _, spans), *_ = [x[:3] for x in model.label([title + body])]
    assert lang == "de" and [s[2] for s in spans] == ["en", "de"] and all(s[:2] == (0, 0) for s in spans)
    (lang, _, spans), *_ = [x[:3] for x in model.label([prose(3, 20) + " " + title + body + " " + prose(4, 20)])]
    assert lang == "de" and spans[0][0] == 0 and spans[-1][1] == 40 and "de" in [s[2] for s in spans]


def plain_label(model, text):
    """The rule word by word: scores from the entries, all paths, letters and shares."""
    import itertools
    import math

    words = langid.pieces(langid.WORD.findall(text.lower()), text.lower())[0]
    entries = {g: {int(model.of[e]): float(model.more[e]) for e in range(model.begin[i], model.begin[i + 1])} for g, i in model.index.items()}
    n, rows, fits = len(model.langs), [], []
    for w in words:
        gs = langid.grams(w)
        score = [sum(float(model.base[x]) + entries[g].get(x, 0.0) for g in gs if g in entries) for x in range(n)]
        fit = [sum(x in entries[g] for g in gs if g in entries) / len(gs) / model.usual[x] for x in range(n)]
        allowed = model.scripts.get(langid.script(w[0]))
        score = [s if allowed is None or allowed[x] else -1e9 for x, s in enumerate(score)]
        fits.append([0.0 if allowed is None or not allowed[x] else fit[x] for x in range(n)])
        top = max(score)
        every = top + math.log(sum(math.exp(s - top) for s in score))
        rows.append([max(model.floor, s - every) for s in score])
    value = lambda p: sum(rows[i][x] for i, x in enumerate(p)) - model.switch * sum(a != b for a, b in zip(p, p[1:]))
    path = max(itertools.product(range(n), repeat=len(words)), key=value)
    size = [len(w) for w in words]
    mass = [sum(s for s, x in zip(size, path) if x == k) for k in range(n)]
    win = mass.index(max(mass))
    sure = sum(math.exp(r[win]) * s for r, s in zip(rows, size)) / sum(size)
    known = sum(f[x] * s for f, x, s in zip(fits, path, size)) / sum(size)
    return model.langs[win], 0.5 * mass[win] / sum(size) + 0.5 * sure, min(1.0, known), value(path)


def test_label_against_brute_force(model):
    for text in [prose(1, 5), prose(2, 6, "de"), prose(3, 3) + " " + prose(4, 4, "de"), "это текст the and", "zzz qqq", "日本 the", prose(5, 2) + "русский" + prose(6, 1)]:
        lang, score, _, known = model.label([text])[0]
        want = plain_label(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4 and abs(known - want[2]) < 1e-2


def test_long_texts_in_steps(model):
    """A text over the cells held at a time has the same path, whatever the steps."""
    for seed in range(4):
        text = " ".join(prose(10 * seed + i, 40, ("en", "de")[i % 2]) for i in range(6))
        whole, parts = model.label([text])[0], model.label([text], cells=60)[0]
        assert whole[0] == parts[0] and whole[2] == parts[2] and abs(whole[1] - parts[1]) < 1e-6 and abs(whole[3] - parts[3]) < 1e-6


def test_runs_of_several_scripts(model):
    assert langid.by_script("абвabc日本") == ["абв", "abc", "日本"] and langid.by_script("café") == ["café"]
    assert [s[2] for s in model.label(["русскийслово" * 3 + prose(1, 40).replace(" ", "").replace(".", "")])[0][2]] == ["ru", "en"]


def test_every_language_is_learned(spark):
    """A rare language keeps its n-grams however many others there are, and however small the model."""
    import random

    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03d}": ["".join(r.choice(letters) for _ in range(5)) for _ in range(30)] for i in range(120)}
    rows = [(1000 * i + k, " ".join(r.choice(ws) for _ in range(40)), lang) for i, (lang, ws) in enumerate(own.items()) for k in range(1 if i == 7 else 4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model_grams=1000)
    assert model.langs == sorted(own) and len(model.of) <= 120 * 500
    got = model.label([" ".join(r.choice(ws) for _ in range(20)) for ws in own.values()])
    assert [g[0] for g in got] == sorted(own)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=100)


def test_marks_belong_to_words(spark):
    assert langid.split("हिन्दी भाषा में लिखा हुआ") == ["हिन्दी", "भाषा", "में", "लिखा", "हुआ"] and langid.split("ภาษาไทยดีมาก") == ["ภาษาไทยดีมาก"] and langid.split("cafe\u0301 ab_c1d") == ["cafe\u0301", "ab", "c", "d"]
    # two languages of one script, told apart by their vowel signs alone
    import random

    r = random.Random(2)
    bases, signs = "कखगतनपमरलसह", {"hi": "ािी", "mr": "ेुू"}
    text = lambda lang: " ".join("".join(r.choice(bases) + r.choice(signs[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(lang), lang) for i in range(60) for lang in ("hi", "mr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang in ("hi", "mr"):
        assert [x[0] for x in model.label([text(lang) for _ in range(20)])] == [lang] * 20


def test_grams_of_many_words_are_those_of_each():
    letters = "abcdeé漢\U00020000कि"
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list(letters), r.integers(1, 10))) for _ in range(400)]
    index = {g: i for i, g in enumerate(dict.fromkeys(g for w in words[:200:2] for g in langid.grams(w)))}
    n = len(index)
    model = langid.Model(["x"], index, np.arange(n + 1), np.zeros(n, np.int64), np.ones(n), np.zeros(1), {}, np.ones(1))
    of_word, found = model.grams_of(words)
    for i, w in enumerate(words):
        assert found[of_word == i].tolist() == [index[g] for g in langid.grams(w) if g in index]
    assert model.grams_of(["zz"])[1].tolist() == [] == langid.Model([], {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), {}, np.ones(0)).grams_of(["zz"])[1].tolist()


@pytest.mark.parametrize("switch", [0.0, 1.5, 6.0])
def test_paths_side_by_side_are_those_alone(switch):
    """Each text's path by a plain search, also where texts end at different words and languages tie."""
    r = np.random.default_rng(5)
    model = langid.Model(list("abc"), {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(3), {}, np.ones(3), switch)
    texts = [r.integers(-8, 1, (n, 3)).astype(np.float32) for n in [1, 30, 7, 7, 2, 90, 0, 1]]
    for x, path in zip(texts, model.paths(texts)):
        best, came = np.zeros(3), []
        for row in x:
            top = int(best.argmax())
            came.append([i if best[i] >= best[top] - switch else top for i in range(3)])
            best = np.maximum(best, best[top] - switch) + row
        want, state = [], int(best.argmax())
        for back in reversed(came):
            want.append(state)
            state = back[state]
        assert path.tolist() == want[::-1]
    assert model.paths([]) == []
