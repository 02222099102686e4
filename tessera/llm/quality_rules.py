"""Quality rules: base counts, and divergence of character classes and common words from language references.

DataFrame functions only; each document is worked on in its own row, and only histograms and sums leave it.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import packed, saved, table, unpacked, words

#: Character classes, by a pattern of what belongs to each; the last class is all else.
CLASSES = ["[a-z]", "[A-Z]", r"[\p{Ll}&&[^a-z]]", r"[\p{L}&&[^\p{Ll}A-Z]]", "[0-9]", r"[ \t-\r]", r"[.,;:!?'\"()\-]"]
SCALE = 1 << 40  # proportions are summed as whole numbers, so that the order of adding doesn't show


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def common_words(docs: DataFrame, most: int = 20, least_docs: int = 20, most_langs: int = 4_096, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The `most` most frequent words of each language that labels at least least_docs documents, counted over all documents.

    Counted by a sketch of bounded size a language: a word over a 5,000th of a language's words can't be missed. A few
    words a language come to the driver; more than most_langs languages are refused (ValueError), as the column then
    holds something else.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    each = known.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang").agg(F.expr(f"approx_top_k(lower(word), {most}, 20000)").alias("top"))
    enough = known.groupBy("lang").count().filter(F.col("count") >= least_docs).select("lang").limit(most_langs + 1)
    rows = each.join(enough, "lang").select("lang", F.transform("top", lambda x: x["item"]).alias("top")).collect()
    if len(rows) > most_langs:
        raise ValueError(f"over {most_langs} languages in {lang_col}")
    return {r["lang"]: sorted(r["top"]) + [""] * (most - len(r["top"])) for r in rows}  # '' is no word, and fills up a short list


def _fixed(values: list, kind: str) -> Column:
    """A constant of nested arrays and structs, written as one literal: the plan has one expression whatever its size."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _finder(lists: dict[str, list[str]]) -> Column | None:
    """The lists as buckets of words by their XXH64: of each word the languages (numbers from 1) that list it, and its place there (from 1)."""
    found: dict[str, list[dict]] = {}
    for i, lang in enumerate(sorted(lists), 1):
        for j, w in enumerate(lists[lang], 1):
            if w:
                found.setdefault(w, []).append({"l": i, "b": j})
    buckets: list = [None] * (2 * len(found) or 1)
    for w in sorted(found):
        at = xxhash.xxh64_intdigest(w.encode(), 42)
        at = (at - (1 << 64) if at >> 63 else at) % len(buckets)
        buckets[at] = [*(buckets[at] or []), {"w": w, "g": found[w]}]
    table = _fixed(buckets, "array<array<struct<w:string,g:array<struct<l:int,b:int>>>>>")
    return lambda w: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(w), F.lit(len(buckets))).cast("int")), lambda x: x["w"] == w), F.lit(0))["g"]


def _runs(values: Column, name: str, df: DataFrame) -> DataFrame:
    """df with `name`: (how often, minus the value) of each value of an array."""
    df = df.withColumn("_tz_v", F.sort_array(values))
    n = F.size("_tz_v")
    df = df.withColumn("_tz_at", F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (i == 0) | (F.get("_tz_v", i) != F.get("_tz_v", i - 1))))
    return df.withColumn(name, F.transform(F.slice("_tz_at", 1, F.greatest(F.size("_tz_at") - 1, F.lit(0))), lambda i, j: F.struct((F.get("_tz_at", j + 1) - i).alias("n"), (-F.get("_tz_v", i)).alias("v")))).drop("_tz_v", "_tz_at")


def base_counts(docs: DataFrame, text_col: str = "text", also: str | None = None, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """_tz_row, the column `also` as _tz_also, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, classes (counts) and common: for each word that is listed, once a language, the language and the place in its list."""
    base = packed(docs, *([also] if also else []), text_col, beside=text_col)
    base = base.select("_tz_row", (F.col(f"_tz_{also}").cast("string") if also else F.lit(None).cast("string")).alias("_tz_also"), F.coalesce(F.col(f"_tz_{text_col}"), F.lit("")).alias("_tz_text"))
    base = base.withColumns({"_tz_words": words(F.col("_tz_text")), "_tz_lines": F.filter(F.split("_tz_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    at = lambda i, k: F.get("_tz_words", i + k)
    hashes = F.when(F.size("_tz_words") > 5, F.transform(F.sequence(F.lit(0), F.size("_tz_words") - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5)))))
    base = base.withColumn("_tz_h", hashes)
    marked = base.withColumn("_tz_sorted", F.when(F.size(F.array_distinct("_tz_h")) < F.size("_tz_h"), F.sort_array(F.transform("_tz_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("_tz_sorted", lambda x, j: same(x, F.get("_tz_sorted", j - 1)) | same(x, F.get("_tz_sorted", j + 1)))
    marked = marked.withColumn("_tz_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_tz_at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_tz_at", j + 1), p + 5) - p)), F.lit(0), lambda a, x: a + x)
    # most of a text is a-z: what is left without it is short, and all else is counted there
    marked = marked.withColumn("_tz_rest", F.regexp_replace("_tz_text", f"{CLASSES[0]}+", ""))
    chars, rest = F.char_length("_tz_text"), F.col("_tz_rest")
    counted = [chars - F.char_length(rest), *(_count(rest, f"{c}+") for c in CLASSES[1:])]
    common = F.flatten(F.array_compact(F.transform(F.transform("_tz_words", F.lower), _finder(lists)))) if lists else F.array().cast("array<struct<l:int,b:int>>")
    return marked.select(
        "_tz_row", "_tz_also", F.size("_tz_words").cast("long").alias("n_words"),
        (chars - _count(rest, r"[ \t-\r]+")).cast("long").alias("word_chars"),
        _count(rest, r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_tz_lines") - F.size(F.array_distinct("_tz_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        chars.cast("long").alias("chars"), F.array(*counted).alias("classes"), common.alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of total, as proportions."""
    rest = total - F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.transform(F.concat(counts, F.array(rest.cast("int"))), lambda x: x / total)


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms, 0 to 1: the root of the divergence in bits."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x)))


def quality_rules(docs: DataFrame, min_words: int = 10, repeat_percent: int = 20, guard_words: int = 40, guard_chars: int = 200, most_classes: float = 0.33, most_both: float = 0.52, top_words: int = 20, least_docs: int = 20, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs without the text, with the counts, base_failed, class_distance, word_distance and kept.

    base_failed: n_words < min_words, or 100 * n_repeat_words > repeat_percent * n_words. A document that passes is kept
    unless its histogram of character classes (guard_chars characters at least) is farther than most_classes from the
    reference of its language, or that distance and the one of its common words (guard_words words at least) together
    are over most_both. A text too short for a guard isn't judged by that histogram.

    References are learned from the documents. A language is a value of lang_col with least_docs documents; its common
    words are the top_words most frequent ones. Its histograms are means over all its documents that pass the base rules
    and the guards, then over those of them within the limits of the first mean, so that junk doesn't define what is
    usual. A text is held against the language it is labelled with and the one of which it has most common words (the
    first in order, if equal), and counts by the nearer. What is known of the languages is one constant each of the plan,
    in which words are found by their hash, so the work doesn't grow with the number of languages. Labels may be wrong or missing; but a text labelled with a language
    without a reference, or without a label and without a common word, is left to the base rules, and so are all if
    lang_col is None or no column.

    Null text: no words; all counts 0, base_failed. Null or odd values in other columns don't matter. Empty input: empty
    output. Columns of the names made here are replaced. Windows are compared by 64-bit hashes within one document.
    """
    labelled = lang_col if lang_col in docs.columns else None
    lists = common_words(docs, top_words, least_docs, text_col=text_col, lang_col=labelled) if labelled else {}
    langs = sorted(lists)
    made = base_counts(docs, text_col, labelled, lists)
    made = made.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    made = made.withColumn("p_classes", F.when(F.col("chars") >= guard_chars, _shares(F.col("classes"), F.col("chars"))))
    # languages as numbers from 1; 0: none
    label = F.coalesce(F.array_position(_fixed(langs, "array<string>"), F.col("_tz_also")).cast("int"), F.lit(0))
    made = _runs(F.transform("common", lambda x: x["l"]), "own", made.withColumn("label", label))
    most = F.coalesce(-F.array_max("own")["v"], F.lit(0))
    unknown = F.col("_tz_also").isNotNull() & (F.col("label") == 0)
    made = made.withColumn("most", F.when(unknown, F.lit(0)).otherwise(most))
    made = made.withColumn("lang", F.when(F.col("label") > 0, F.col("label")).otherwise(F.col("most"))).withColumn("other", F.when(F.col("most") != F.col("lang"), F.col("most")).otherwise(F.lit(0)))
    for g in ("lang", "other"):
        made = made.withColumn(f"in_{g}", F.transform(F.filter("common", lambda x: x["l"] == F.col(g)), lambda x: x["b"]))
    times = lambda g: F.transform(F.sequence(F.lit(1), F.lit(top_words)), lambda b: F.size(f"in_{g}") - F.size(F.array_remove(f"in_{g}", b)))
    p_words = lambda g: F.when((F.col("n_words") >= guard_words) & (F.col(g) > 0), _shares(times(g), F.col("n_words")))
    made = saved(made.withColumn("p_words", p_words("lang")).withColumn("p_other", p_words("other")).drop("classes", "common", "own", "label", "most", "in_lang", "in_other", "_tz_also", "chars"))

    sound = made.filter(~F.col("base_failed") & (F.col("lang") > 0) & F.col("p_classes").isNotNull() & F.col("p_words").isNotNull())
    far = lambda c, w: F.coalesce(c > most_classes, F.lit(False)) | F.coalesce(c + w > most_both, F.lit(False))
    first = _references(sound, top_words + 1)
    near = ~far(_distance("p_classes", "lang", first, "classes"), _distance("p_words", "lang", first, "words"))
    refs = first | _references(sound.filter(near), top_words + 1)
    for name, own_p, other_p in (("class_distance", "p_classes", "p_classes"), ("word_distance", "p_words", "p_other")):
        kind = name.split("_")[0] + ("es" if own_p == "p_classes" else "s")
        made = made.withColumn(name, F.least(_distance(own_p, "lang", refs, kind), _distance(other_p, "other", refs, kind)))
    odd = far(F.col("class_distance"), F.col("word_distance"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    return unpacked(made, docs, text_col, **{c: F.col(c) for c in names}, kept=~F.col("base_failed") & ~odd)


def _references(sound: DataFrame, bins: int) -> dict[int, dict[str, list[float]]]:
    """For each language (1, 2, ...) the mean histograms: one row a language comes to the driver."""
    whole = lambda c, i: F.coalesce(F.sum(F.floor(F.get(c, i) * SCALE).cast("decimal(20,0)")), F.lit(0))
    sums = [whole("p_classes", i).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [whole("p_words", i).alias(f"w{i}") for i in range(bins)]
    out = {}
    for r in sound.groupBy("lang").agg(*sums).collect():
        histograms = {}
        for name, letter, n in (("classes", "c", len(CLASSES) + 1), ("words", "w", bins)):
            values = [float(r[f"{letter}{i}"]) for i in range(n)]
            histograms[name] = [v / sum(values) for v in values]
        out[r["lang"]] = histograms
    return out


def _distance(column: str, lang: str, refs: dict[int, dict[str, list[float]]], name: str) -> Column:
    """To the reference of the language; null without one or without a histogram."""
    if not refs:
        return F.lit(None).cast("double")
    all_ = _fixed([refs[g][name] if g in refs else None for g in range(1, max(refs) + 1)], "array<array<double>>")
    own = F.get(all_, F.col(lang) - 1)
    return F.when(F.col(column).isNotNull() & own.isNotNull(), divergence(F.col(column), own))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang", "class_distance", "word_distance")


def op5_counts_oracle() -> str:
    """The base columns in DuckDB, for tests: kept isn't in it, which depends on the method."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
       len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN r USING (doc_id)
"""
