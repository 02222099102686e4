"""Evaluation questions: passages worth asking about, rule-based questions, filters, quotas and seeded samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.code import shipped

SENTENCE = re.compile(r"(?<=[.!?])\s+")
NAME, DIGIT = re.compile("[A-Z][a-z]+"), re.compile(r"\d")
BEST, SHORT, LONG, PACK, PASSAGES = 5, 100, 800, 500, 3


def score_sentence(sentence: str, position: int, count: int) -> int:
    """How much a sentence says; the column form is functions.text.sentence_score()."""
    words, names, low = len(sentence.split()), len(NAME.findall(sentence)), sentence.lower()
    tests = [words > 8, words > 15, names > 0, names > 2, bool(DIGIT.search(sentence)), any(w in low for w in T.QUESTION_WORDS), any(w in low for w in T.KEY_VERBS), 0.25 <= position / count <= 0.75]
    return sum(tests)


def packs(sentences: list[str], said: str) -> Iterator[str]:
    """Sentences that aren't said yet, in order, joined to just under PACK letters; packs of over SHORT are given, and are said then."""
    held: list[str] = []
    for s in [*sentences, None]:
        if s is not None and s in said:
            continue
        joined = " ".join(held)
        if s is not None and len(joined) + len(s) < PACK:
            held.append(s)
            continue
        if len(joined) > SHORT:
            said += " " + joined
            yield joined
        held = [s or ""]


def passages(text: str) -> list[str]:
    """Up to three passages of a chunk.

    The five best sentences, each with the nearest free sentence of the two before it (the first sentence of a text is
    never taken so) and of the two after it, make passages if 100 to 800 characters long. Under three, the sentences that
    no passage holds are packed, in order, to under 500 characters, and packs of over 100 count. If there is none at all,
    the first three sentences are one.
    """
    sentences = SENTENCE.split(text)
    n = len(sentences)
    ranked = sorted((i for i in range(n) if sentences[i].strip()), key=lambda i: -score_sentence(sentences[i], i, n))
    taken: set[int] = set()
    out: list[str] = []
    for i in ranked[:BEST]:
        if i in taken:
            continue
        before = next((j for j in (i - 1, i - 2) if j >= 1 and j not in taken), None)
        after = next((j for j in (i + 1, i + 2) if j < n and j not in taken), None)
        group = [j for j in (before, i, after) if j is not None]
        taken.update(group)
        joined = " ".join(sentences[j] for j in group)
        if SHORT <= len(joined) <= LONG:
            out.append(joined)
    if len(out) < PASSAGES:
        out += packs(sentences, " ".join(out))
    if not out:
        first = " ".join(sentences[:PASSAGES])
        out = [first] if first else []
    return out[:PASSAGES]


def significant_passages(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage_index, passage): what each chunk's text gives; null texts give nothing."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passages(t) if t else [] for t in b.column(1).to_pylist()]
            take = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array([i for x in found for i in range(len(x))], pa.int32()), pa.array([p for x in found for p in x], pa.string())], names=[id_col, "passage_index", "passage"])

    return shipped(chunks).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, passage_index int, passage string")


def with_questions(found: DataFrame) -> DataFrame:
    """passages with a rule-based question and reject_reason ('kept' if it passes all filters)."""
    out = found.withColumn("question", T.question_text(T.fallback_question(F.col("passage"))))
    return out.withColumn("reject_reason", T.reject_reason(F.col("question"), T.clean(F.col("passage"))))


def rounds(found: DataFrame, by: str, ask: Callable[[Column, Column], Column], wanted: int = 3, most: int = 10) -> DataFrame:
    """(by, attempt from 0, passage, question): the first `wanted` questions of each group that pass all filters.

    found: by, passage_index, passage. A group's passages take turns; there are twice as many attempts as passages, `most`
    at most. ask(passage, attempt) is the question of an attempt, or null.
    """
    size = found.groupBy(by).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("passage_index", "passage"))).alias("_all"))
    turns = size.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.least(2 * F.col("_n"), F.lit(most)) - 1)))
    turns = turns.withColumn("passage", F.get("_all", F.pmod("attempt", "_n").cast("int"))["passage"])
    turns = turns.withColumn("question", T.question_text(ask(F.col("passage"), F.col("attempt"))))
    kept = turns.filter(T.reject_reason(F.col("question"), T.clean(F.col("passage"))) == "kept")
    kept = kept.withColumn("_d", F.row_number().over(W.partitionBy(by).orderBy("attempt"))).filter(F.col("_d") <= wanted)
    return kept.select(by, "attempt", "passage", "question")


def quota(questions: DataFrame, by: str, order: list[str], per_group: int, total: int | None = None) -> DataFrame:
    """The first per_group kept questions of each group, and of those the first `total`, if given."""
    kept = questions.filter("reject_reason = 'kept'").withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("place") <= per_group)
    return kept if total is None else kept.orderBy("place", by, *order).limit(total)


def sample_per_group(rows: DataFrame, by: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group, chosen by a seeded hash of the key: the same on every run."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("_d", F.row_number().over(W.partitionBy(by).orderBy(draw, key))).filter(F.col("_d") <= n).drop("_d")


def sample_groups(rows: DataFrame, by: str, key: str, groups: int, seed: int = 7) -> DataFrame:
    """One row of each of `groups` groups, both chosen by a seeded hash."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")), 256)
    chosen = rows.select(by).distinct().orderBy(draw, by).limit(groups)
    return sample_per_group(rows.join(chosen, by, "left_semi"), by, key, 1, seed)
