"""Language identification: script ranges, per-word scores from character n-grams, Viterbi with a switching penalty."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import fold, packed, row_and, saved, shipped, table, unpacked

LATIN = re.compile(r"[^\W\d_]+")
#: Letters with the signs that belong to them: vowels and tones of Indic and other scripts, combining accents, joiners.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}\u200C\u200D]*")
#: Where blocks of one script begin in Unicode, and the script from there on ('' is any other).
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"),
    (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
]
_STARTS = [a for a, _ in SCRIPTS]
#: What no text of Latin letters only has: a sign of another block, but for general punctuation and what follows up to arrows.
OTHER = re.compile("[^\x00-\u02AF\u1E00-\u1EFF\u2000-\u21FF]")
#: A run of more letters is judged in pieces, each a place of the path: script without spaces, text that lost them.
PIECE = 64
#: Bits of a sign, of which three make a number; and a number over all of those.
SIGN, LAST = 21, (1 << 63) - 1


def split(text: str) -> list[str]:
    """The words of a text: runs of letters."""
    return WORD.findall(text) if OTHER.search(text) else LATIN.findall(text)


def script(char: str) -> str:
    i = bisect_right(_STARTS, ord(char)) - 1
    return SCRIPTS[i][1] if i >= 0 else ""


def by_script(word: str) -> list[str]:
    """The word cut where its script changes; signs of no script here go with what is before them."""
    if not OTHER.search(word):
        return [word]
    cuts, last = [0], ""
    for i, c in enumerate(word):
        now = script(c)
        if now and last and now != last:
            cuts.append(i)
        last = now or last
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]


def pieces(words: list[str], text: str) -> tuple[list[str], list[int] | None]:
    """What is judged of a text's words, and of which word each is (None: one a word): words cut by script, and those of over PIECE letters into pieces of like length."""
    if max(map(len, words), default=0) <= PIECE and (text.isascii() or not OTHER.search(text)):
        return words, None
    out, of = [], []
    for k, w in enumerate(words):
        for part in by_script(w):
            n = -(-len(part) // PIECE)
            out += [part[len(part) * i // n:len(part) * (i + 1) // n] for i in range(n)]
            of += [k] * n
    return (words, None) if len(out) == len(words) else (out, of)


def grams(word: str) -> list[str]:
    """Pairs and triples of characters of a word between marks of its ends, and the word itself if short."""
    w = f"_{word}_"
    out = [w[i:i + 2] for i in range(len(w) - 1)] + [w[i:i + 3] for i in range(len(w) - 2)]
    return out + ["=" + word] if len(word) <= 6 else out


def numbers(signs: np.ndarray) -> np.ndarray:
    """Each row of signs, three at most, as one number."""
    return functools.reduce(lambda x, c: x << SIGN | c, signs.T)


@dataclass
class Model:
    """langs in order. Gram g of the index has the entries begin[g] to begin[g + 1]: a language, and how much likelier the gram is there than one not seen.

    base: log likelihood of a gram not seen, by language. scripts[s]: which languages are written in s. usual: the share of
    a new text's grams that the model should have of each language, by Good and Turing's estimate. At most `limit` words
    (fewer, if there are many languages) are remembered at a time, which changes no result.
    """

    langs: list[str]
    index: dict[str, int]
    begin: np.ndarray
    of: np.ndarray
    more: np.ndarray
    base: np.ndarray
    scripts: dict[str, np.ndarray]
    usual: np.ndarray
    switch: float = 6.0
    floor: float = -8.0
    limit: int = 200_000
    known: dict[str, int] = field(default_factory=dict)
    keys: np.ndarray = field(init=False)
    key_of: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.limit = min(self.limit, max(1024, 4_000_000 // max(1, len(self.langs))))
        self.fits = np.zeros((self.limit, max(1, len(self.langs))), np.float16)
        self.table = np.zeros((self.limit, max(1, len(self.langs))), np.float32)
        keys, places = [np.array([LAST])], [np.array([0])]
        for size in (2, 3):
            own = [g for g in self.index if len(g) == size and g[0] != "="]
            keys.append(numbers(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, size)))
            places.append(np.fromiter(map(self.index.__getitem__, own), np.int64, len(own)))
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(keys)
        self.keys, self.key_of = keys[order], places[order]  # pairs and triples of signs as numbers; the last is none

    def grams_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each gram of the words that the index has: place of the word, and of the gram in the index; a word's grams stand in the order of grams().

        The words are one run of signs with '_' between; pairs and triples of signs are sought as numbers, all at once.
        """
        signs = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), np.uint32).astype(np.int64)
        mark = signs == ord("_")
        word = np.cumsum(mark) - 1  # of the pair or triple that begins there
        two = (signs[:-1] << SIGN) | signs[1:]
        inside = np.flatnonzero(~mark[1:-1])
        three = (two[inside] << SIGN) | signs[inside + 2]
        sought, of_word = np.concatenate([two, three]), np.concatenate([word[:-1], word[inside]])
        at = np.searchsorted(self.keys, sought)
        hit = self.keys[at] == sought
        whole = [(i, k) for i, w in enumerate(words) if len(w) <= 6 and (k := self.index.get("=" + w)) is not None]
        i, k = np.array(whole, np.int64).reshape(-1, 2).T
        return np.concatenate([of_word[hit], i]), np.concatenate([self.key_of[at[hit]], k])

    def learn(self, words: list[str]) -> None:
        """Scores of new words, into the table: log posteriors under equal priors, not below the floor.

        Into fits: the share of a word's grams that each language has, to the usual one; 0 where no language is written in
        its script.
        """
        every = np.array([2 * len(w) + 1 + (len(w) <= 6) for w in words], np.float64)  # of grams(w)
        n = len(self.langs)
        of_word, flat = self.grams_of(words)
        sizes = np.bincount(of_word, minlength=len(words))
        held = self.begin[flat + 1] - self.begin[flat]
        entry = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.begin[flat], held)
        cell = np.repeat(of_word, held) * n + self.of[entry]
        total = sizes[:, None] * self.base + np.bincount(cell, self.more[entry], len(words) * n).reshape(-1, n)
        fits = np.bincount(cell, minlength=len(words) * n).reshape(-1, n) / every[:, None]
        firsts = [w[0] for w in words]
        named = {c: script(c) for c in set(firsts)}
        for name in set(named.values()):
            own = np.fromiter((named[c] == name for c in firsts), bool, len(words))
            allowed = self.scripts.get(name)
            if allowed is not None:
                total[np.ix_(own, ~allowed)] = -1e9
            fits[np.ix_(own, ~allowed if allowed is not None else np.ones(n, bool))] = 0
        top = total.max(axis=1, keepdims=True)
        total -= top + np.log(np.exp(total - top).sum(axis=1, keepdims=True))
        total = np.maximum(total, self.floor)
        at = len(self.known)
        self.table[at:at + len(words)] = total
        self.fits[at:at + len(words)] = fits / self.usual
        self.known.update(zip(words, range(at, at + len(words))))

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the table for words; at most `limit` words are remembered at a time."""
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            fresh = list({w for w in words if w not in known})
        if len(known) + len(fresh) > self.limit:
            known.clear()
            fresh = list(set(words))
        if len(fresh) > self.limit:  # one text with more kinds of words than are remembered: in parts
            raise OverflowError(len(words) // 2)
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table and of the fits."""
        try:
            places = self.places(words)
            return self.table[places], self.fits[places]
        except OverflowError as e:
            parts = self.emissions(words[:e.args[0]]), self.emissions(words[e.args[0]:])
            return tuple(map(np.concatenate, zip(*parts)))

    def paths(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each text (a matrix: words by languages), texts side by side."""
        n, k = len(texts), len(self.langs)
        length = np.array([len(x) for x in texts])
        order = np.argsort(-length, kind="stable")
        long = int(length.max(initial=0))
        scores = np.zeros((long, k, n), np.float32)
        for j, i in enumerate(order):
            scores[: length[i], :, j] = texts[i]
        alive = np.searchsorted(-length[order], -np.arange(1, long + 1), side="right")  # texts with a word there
        high = np.float32(-self.switch)  # the best language's is 0
        for t in range(long):  # scores of words become those of paths to there
            b = scores[t, :, :alive[t]]
            b += np.maximum(scores[t - 1, :, :alive[t]], high) if t else max(high, np.float32(0))
            b -= b.max(axis=0)  # what all share says nothing, and would cost digits
        path = np.zeros((long, n), np.int16)
        at, last = np.arange(n), length[order] - 1
        state = np.where(last >= 0, scores[last, :, at].argmax(axis=1), 0) if long else np.zeros(n, np.int64)
        for t in range(long - 1, -1, -1):
            m = alive[t]
            path[t, :m] = state[:m]
            if t:
                left = np.flatnonzero(scores[t - 1, state[:m], at[:m]] < high)
                if len(left):
                    state[left] = scores[t - 1][:, left].argmax(axis=0)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        for j, i in enumerate(order):
            out[i] = path[: length[i], j]
        return out

    def long_path(self, words: list[str], step: int) -> np.ndarray:
        """paths() of one text, `step` words at a time: of each word only its best predecessor and a bit a language are kept."""
        best, n = np.zeros(len(self.langs), np.float32), len(words)
        tops, stays = np.zeros(n, np.int32), np.zeros((n, -(-len(self.langs) // 8)), np.uint8)
        for at in range(0, n, step):
            for t, scores in enumerate(self.emissions(words[at:at + step])[0], at):
                tops[t] = best.argmax()
                high = best[tops[t]] - self.switch
                stay = best >= high
                stays[t] = np.packbits(stay)
                best = np.where(stay, best, high) + scores
                best -= best.max()
        path, state = np.zeros(n, np.int32), int(best.argmax())
        for t in range(n - 1, -1, -1):
            path[t] = state
            if not stays[t, state >> 3] >> (7 - (state & 7)) & 1:
                state = int(tops[t])
        return path

    def verdict(self, words: list[str], path: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]] | None, step: int) -> tuple[str, float, float]:
        """(language, score, evidence) of a path; blocks: the emissions, worked out again step by step if None."""
        letters = np.fromiter(map(len, words), np.int64, len(words))
        mass = np.bincount(path, weights=letters, minlength=len(self.langs))
        win, all_, sure, known = int(mass.argmax()), letters.sum(), 0.0, 0.0
        at = 0
        for matrix, fits in blocks or (self.emissions(words[i:i + step]) for i in range(0, len(words), step)):
            own = letters[at:at + len(matrix)]
            sure += float((np.exp(matrix[:, win].astype(np.float64)) * own).sum())
            known += float((fits[np.arange(len(own)), path[at:at + len(own)]].astype(np.float64) * own).sum())
            at += len(own)
        score = 0.5 * mass[win] / all_ + 0.5 * sure / all_
        return self.langs[win], float(min(1.0, max(0.0, score))), float(min(1.0, known / all_))

    def label(self, texts: list[str | None], cells: int = 2_000_000) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """(language, score, spans of words, evidence) of each text; about `cells` emissions are held at a time.

        Evidence: the share of grams, by letters, that the language of the path there has, to its usual one. It speaks for the text being in
        learned languages, one or several; it has no floor, and doesn't depend on which language is the likeliest.
        """
        low = [(t or "").lower() for t in texts]
        found = [split(t) for t in low]
        cut = [pieces(ws, t) if any(c.isalpha() for w in ws for c in w) else ([], None) for ws, t in zip(found, low)]  # LATIN also takes signs like ½
        out: list = [("und", 0.0, [], 0.0)] * len(texts)
        if not self.langs:
            return out
        words = [ws for ws, _ in cut]
        todo = sorted((i for i in range(len(texts)) if words[i]), key=lambda i: len(words[i]))
        at, step = 0, max(1, cells // len(self.langs))
        every = set().union(*words)
        if len(every) <= self.limit:  # all new words of the texts at once
            self.places(list(every))
        while at < len(todo):
            # texts of like length side by side; a long one alone, in steps
            end = at + 1
            while end < len(todo) and end - at < 512 and len(words[todo[end]]) * (end - at + 1) <= step:
                end += 1
            some = todo[at:end]
            if len(words[some[0]]) > step:
                found = [(some[0], self.long_path(words[some[0]], step), None)]
            else:
                matrices = [self.emissions(words[i]) for i in some]
                found = list(zip(some, self.paths([m for m, _ in matrices]), matrices))
            for i, path, matrix in found:
                lang, score, known = self.verdict(words[i], path, matrix and [matrix], step)
                starts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
                of = cut[i][1] or range(len(path))  # spans count words; one whose pieces differ is in both
                spans = [(int(of[a]), int(of[b - 1]), self.langs[path[a]]) for a, b in zip(starts, starts[1:])]
                out[i] = (lang, score, spans, known)
            at = end
        return out


def fit(docs: DataFrame, sample: int = 2_000, model_grams: int = 400_000, lang_grams: int = 50_000, most_langs: int = 4_096, switch: float = 6.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in docs, from about `sample` whole texts of each (chosen by a hash of the id).

    Rows without text or language teach nothing; a language none of whose texts has a letter isn't learned. The model
    holds the most frequent n-grams of each language: lang_grams, or its share of model_grams where there are many
    languages, but 500. Every language is learned: more than most_langs are refused (ValueError), not cut, as the column
    then holds something else.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col, F.lit(11)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"over {most_langs} languages in {lang_col}")
    if not counts:
        return Model([], {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), {}, np.ones(0), switch)
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, share double")
    unit = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(shares), "lang").filter(unit < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower()
                for w, n in Counter(pieces(split(low), low)[0]).items():
                    found[lang, "s" + script(w[0])] += n
                    own = grams(w)
                    found[lang, "t"] += n * len(own)
                    for g in own:
                        found[lang, "g" + g] += n
            if len(found) > 500_000:
                yield told(found)
                found.clear()
        yield told(found)

    def told(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "what", "n"])

    seen = saved(shipped(chosen).mapInArrow(count, "lang string, what string, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in seen.select("lang").distinct().collect())
    if not langs:
        return fit(docs.limit(0), sample, model_grams, lang_grams, most_langs, switch, id_col, text_col, lang_col)
    budget = min(lang_grams, max(500, model_grams // len(langs)))
    is_gram, order = F.col("what").startswith("g"), W.partitionBy("lang").orderBy(F.desc("n"), "what")
    got = seen.filter(is_gram).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).select("lang", "what", "n").collect()
    place = {x: i for i, x in enumerate(langs)}
    got = sorted((r.what[1:], place[r.lang], r.n) for r in got)
    index = {g: i for i, g in enumerate(dict.fromkeys(g for g, _, _ in got))}
    gram, of, n = (np.array(x) for x in zip(*((index[g], i, c) for g, i, c in got)))
    total = np.bincount(of, n, len(langs)) + 0.5 * len(index)  # half a sighting for each gram of the index
    begin = np.searchsorted(gram, np.arange(len(index) + 1))
    every, by_script_ = np.ones(len(langs)), {}
    for r in seen.filter(~is_gram).collect():  # a row a language, and one for each of its scripts
        if r.what == "t":
            every[place[r.lang]] = r.n
        else:
            by_script_.setdefault(r.what[1:], np.zeros(len(langs)))[place[r.lang]] = r.n
    all_ = np.sum(list(by_script_.values()), axis=0)
    allowed = {s: x >= 0.01 * all_ for s, x in by_script_.items() if s}
    allowed = {s: x & (by_script_[s] > 0) for s, x in allowed.items()}
    usual = np.clip(np.bincount(of, n * (n > 1), len(langs)) / every, 0.2, 1)
    return Model(langs, index, begin, of, np.log1p(n / 0.5), np.log(0.5 / total), {s: x for s, x in allowed.items() if x.any()}, usual, switch)


def identify(docs: DataFrame, model: Model, spans: bool = True, text_col: str = "text", keep_text: bool = True, evidence: bool = False) -> DataFrame:
    """docs with lang_pred, score and, if asked, spans: array of (first word, last word, language), words from 0.

    A word is a run of letters, with the marks that belong to them; one of several scripts or of more than PIECE letters is judged in pieces, and may end a
    span and begin the next. lang_pred has most letters in its spans; score is half its share of the letters and half the
    mean posterior of the words for it, 0 to 1. Null texts and texts without a letter: 'und', 0 and no spans; so are
    all texts if the model knows no language. Ties go to the language first in order. Whole texts are read, of any length.
    If asked, evidence: the share of n-grams that the languages of the spans have, by letters; 0 for a word in a script that
    no learned language uses. Columns of these names are replaced; others pass.
    """
    base = packed(docs, text_col, beside=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.begin, model.of, model.more, model.base, model.scripts, model.usual, model.switch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = own.label(b.column(1).to_pylist())
                parts = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                if spans:
                    parts.append(pa.array([[{"first_word": p, "last_word": q, "lang": g} for p, q, g in x[2]] for x in found], span))
                if evidence:
                    parts.append(pa.array([x[3] for x in found], pa.float64()))
                if keep_text:
                    parts.append(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *parts], names=names)

    names = ["_tz_row", "a", "b"] + ["c"] * spans + ["e"] * evidence + ["t"] * keep_text
    kind = "a string, b double" + ", c array<struct<first_word:int,last_word:int,lang:string>>" * spans + ", e double" * evidence + ", t string" * keep_text
    out = shipped(base).mapInArrow(run, row_and(base, kind))
    added = ({text_col: F.col("t")} if keep_text else {}) | {"lang_pred": F.col("a"), "score": F.col("b")} | ({"spans": F.col("c")} if spans else {}) | ({"evidence": F.col("e")} if evidence else {})
    return unpacked(out, docs, None if keep_text else text_col, **added)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    held = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(held, model, spans=False, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")
