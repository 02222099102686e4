"""Smaller expressions: names and ids, prompts, metadata, probabilities, and phrases that tell a passage apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import sentences_after, tokens

#: The entries of a file's metadata that are kept.
METADATA = ["author", "language", "moddate", "title", "total_pages"]
#: Letters and digits of Unicode 14 and 15, which Java 17 (Unicode 13) takes for neither, as ranges of code points.
NEW_LETTERS = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a
1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240
11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb
1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb
1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af
"""
_NEW = "".join("-".join(f"\\x{{{c}}}" for c in r.split("-")) for r in NEW_LETTERS.split())


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def legacy_id(name: Column, index: Column) -> Column:
    """The older ids: a file's name and the place of the chunk."""
    return F.concat_ws("_", name, index.cast("string"))


def safe_title(title: Column) -> Column:
    """Letters, digits, spaces, '-' and '_' of a title, 250 at most, for use as a file's name."""
    return F.substring(F.trim(F.regexp_replace(title, r"[^\p{L}\p{N}" + _NEW + " _-]", "")), 1, 250)


def paper_id(name: Column) -> Column:
    """The id that a paper's file name begins with, or ''."""
    return F.regexp_extract(name, r"^(\d{4}\.\d{5}v\d+)_", 1)


def kept_metadata(entries: Column) -> Column:
    """The allowed entries of a metadata map."""
    return F.map_filter(entries, lambda k, v: k.isin(METADATA) & v.isNotNull())


def yes_probability(yes: Column, no: Column) -> Column:
    """Two logits to the probability of the first."""
    return 1.0 / (1.0 + F.exp(no - yes))


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def distinctive_phrases(text: Column) -> Column:
    """The first ten words of each sentence of over five that has a name or a number."""
    some = F.filter(sentences_after(text), lambda s: (F.size(tokens(s)) > 5) & s.rlike(r"(?U)[A-Z][a-z]+|\d"))
    return F.transform(some, lambda s: F.array_join(F.slice(tokens(s), 1, 10), " "))


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer only from the context. If it does not hold the answer, say that you do not know.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def question_prompt(passage: Column, phrases: Column) -> Column:
    told = F.when(F.size(phrases) > 0, F.concat(F.lit(" It should concern: "), F.array_join(F.slice(phrases, 1, 3), "; "), F.lit("."))).otherwise(F.lit(""))
    return F.concat(F.lit("Write one question that this text answers and that stands on its own."), told, F.lit("\n\nText:\n"), passage)


def check_prompt(context: Column, question: Column, answer: Column) -> Column:
    """Asks for the reply that functions.text.verdict() reads."""
    return F.concat(F.lit("Does the context support the answer? Reply with three lines: 'Valid: Yes' or 'Valid: No'; 'Confidence: ' and a number from 0 to 1; 'Issues: ' and a list with semicolons, or None.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer: "), answer)
