"""Text expressions of the retrieval engine, all as Catalyst columns.

Words are bounded as in Unicode-aware regular expressions: a word character is a letter, a digit or '_'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases and patterns that scores and filters are defined by.
UNCERTAIN = ["i think", "maybe", "possibly", "i'm not sure", "it seems", "appears to be", "might be", "could be", "probably", "i believe", "it's likely", "presumably", "supposedly", "i don't know", "i cannot", "i can't", "unclear", "uncertain"]
HEDGES = ["may be", "could be", "might be", "seems? to", "appears? to", "looks? like", "perhaps", "maybe"]
DEFINITE = ["is", "are", "was", "were", "will", "does", "did"]
COVERAGE_PATTERNS = [
    r"\b\d{4}\b", r"\b\d+\s*(percent|%|dollars?|years?|months?|days?)\b", r"\bfounded in\b.*", r"\blocated in\b.*",
    r"\bknown (for|as)\b.*", r"\b(is|are|was|were)\s+.*\b",
]
ATTRIBUTION_PATTERNS = [
    r"\b[A-Z][a-z]+ (?:is|was|are|were|has|have) [^.!?]+", r"\b\d{4}\b[^.!?]*",
    r"\b\d+(?:\.\d+)?\s*(?:percent|%|million|billion|thousand|dollars?)[^.!?]*", r"\b(?:founded|established|created|built) (?:in|by|on) [^.!?]+",
    r"\b(?:located|based|situated) (?:in|at|on) [^.!?]+", r"\bknown (?:for|as) [^.!?]+",
]
ENTITY_PATTERNS = [r"\b\d{4}\b", r"\b\d+(?:\.\d+)?\s*(?:percent|%|million|billion|thousand|dollars?)\b"]
ENTITY_NAMES = [r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,\s*\d{4})?\b"]
STOP_WORDS = """the a an and or but in on at to for of with by from up about into through during before after above below between among
within is are was were be been being have has had do does did will would could should may might this that these those i me my myself we
us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves""".split()
CONTEXTLESS = ["this text", "this passage", "these texts", "this document", "this section", "this chapter", "this story", "this example", "in this context", "in the text", "he say(?:s|ing)?", "she say(?:s|ing)?", "they say(?:s|ing)?", "talking about here", "referring to here", "mentioned here"]
PRONOUNS = ["he", "she", "they", "his", "her", "their"]
REFERENCES = ["the passage", "the text", "this passage", "this text", "the speaker", "the author", "according to", "the document", "this document", "in the passage", "in the text", "the provided context", "this context", "the context", "in the context", "the given context", "described in the", "mentioned in the", "what does .* say", "what does .* think", "what does .* feel", "what aspect does .* feel", "what .* feel is"]
VAGUE = ["how long has .* been", "how many years .* been", r"what does .* do\?$", r"who is .*\?$", r"what is .* about\?$", r"how does .* work\?$", r"why does .* matter\?$", r"what are .* like\?$", r"how can .* help\?$", r"what makes .* important\?$", "is mentioned", "are mentioned", "was mentioned", "were mentioned", "mentioned as", "mentioned in", "the person", "the individual", "the company(?! [A-Z])", "this person", "this individual", "this company(?! [A-Z])", "someone", "they are", "it is", "what are some"]
INDICATORS = ["I ask you", "let me ask you", "I want to ask", "the question is", "my question is", "ask yourself", "we must ask", "consider this", "think about"]
QUESTION_WORDS = ["what", "why", "how", "who", "when", "where"]
KEY_VERBS = ["means", "signifies", "represents", "shows", "tells", "explains"]
NAVIGATION = ["edit", "view", "history", "talk", "skip to", "jump to", "menu", "search"]
STOPS = [r"```", r"def\s+\w+\(", r"print\s*\(", "Question:", "Let me know", "Do you want", "I'm waiting", "I apologize", "Thank you", "You're welcome", "My intention", "My previous response", "I was attempting", "Therefore,", "In conclusion,", "---", r"\.{3,}"]
ARTIFACTS = [r"\b(ame|---).*", "The provided text.*", "Based solely on.*given text.*", "I apologize.*", "Thank you.*", "My intention.*"]

B = r"[^\p{L}\p{N}_]"  # what bounds a word


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row: a lambda's variable, where a column would be repeated in place."""
    return F.get(F.transform(F.array(value), body), 0)


def has_word(text: Column, pattern: str, flags: str = "") -> Column:
    """Whether pattern occurs in text with word bounds on both sides."""
    return text.rlike(f"{flags}(^|{B})({pattern})({B}|$)")


def clean(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))


def overlap(a: Column, b: Column) -> Column:
    """Shared token kinds over those of the smaller side; 0 if either has none. Arguments are token_set()s."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def keyword_score(query: Column, passage: Column) -> Column:
    """The share of the query's token kinds that the passage has; 0.5 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, passage)) / F.size(query)).otherwise(F.lit(0.5))


def sentences_after(text: Column) -> Column:
    """Sentences with their end marks: cut at white space after one of . ! ?"""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def confidence(text: Column) -> Column:
    """1, less 0.15 for each uncertain phrase and 0.1 for each hedge, plus 0.1 for over two definite verbs; within 0 to 1."""
    low = F.lower(text)
    out = F.lit(1.0)
    for p in UNCERTAIN:
        out = out - F.when(F.contains(low, F.lit(p)), F.lit(0.15)).otherwise(F.lit(0.0))
    for p in HEDGES:
        out = out - F.when(has_word(low, p), F.lit(0.1)).otherwise(F.lit(0.0))
    definite = sum((has_word(low, p).cast("int") for p in DEFINITE), F.lit(0))
    out = out + F.when(definite > 2, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def _phrases(text: Column, patterns: list[str], most: int) -> Column:
    """Matches of the patterns in each sentence of ten characters at least; kept if over five characters; distinct, first ones."""
    cut = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) >= 10)
    found = F.flatten(F.transform(cut, lambda s: F.flatten(F.array(*(F.regexp_extract_all(s, F.lit("(?iuU)" + p), F.lit(0)) for p in patterns)))))
    found = F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: F.length(p) > 5)
    pairs = let(found, lambda f: F.transform(f, lambda p: F.struct(F.lower(p).alias("low"), p.alias("p"))))

    def firsts(ps: Column) -> Column:
        return let(F.transform(ps, lambda x: x["low"]), lambda low: F.filter(ps, lambda x, i: F.array_position(low, x["low"]) == i + 1))

    return F.slice(F.transform(let(pairs, firsts), lambda x: x["p"]), 1, most)


def coverage_phrases(text: Column) -> Column:
    return _phrases(text, COVERAGE_PATTERNS, 10)


def attribution_phrases(text: Column) -> Column:
    return _phrases(text, ATTRIBUTION_PATTERNS, 15)


def coverage(phrases: Column, context: Column) -> Column:
    """The share of phrases with a word of over three characters that is within the context; 1 without phrases."""

    def share(ps: Column) -> Column:
        backed = let(F.lower(context), lambda low: F.filter(ps, lambda p: F.exists(tokens(F.lower(p)), lambda w: (F.length(w) > 3) & F.contains(low, w))))
        return F.when(F.size(ps) > 0, F.size(backed) / F.size(ps)).otherwise(F.lit(1.0))

    return let(phrases, share)


def significant_words(text: Column) -> Column:
    """Kinds of words that matter for attribution: ASCII words without short and stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z0-9]+\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS) & ~(w.rlike("^[a-z]+$") & (F.length(w) < 4))))


def entities(text: Column, mode: str = "compat") -> Column:
    """Years and numbers with units in lower-cased text, which is all that the original's patterns can match there.

    mode='fixed': patterns are looked for in the text as it is, so names and dates are found too, and so is a percent sign
    before a space; the entities are lower-cased afterwards.
    """
    if mode == "fixed":
        patterns = [ENTITY_PATTERNS[0], ENTITY_PATTERNS[1].replace("%|", "").replace(")\\b", ")\\b|\\b\\d+(?:\\.\\d+)?\\s*%"), *ENTITY_NAMES]
        found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in patterns)))
        return F.array_distinct(F.transform(found, lambda x: F.trim(F.lower(x))))
    low = F.lower(text)
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(0)) for p in ENTITY_PATTERNS)))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def contribution(phrases: Column, words: Column, things: Column, doc: Column, doc_words: Column, doc_things: Column) -> Column:
    """0.4 of the phrases within the document, 0.3 of the answer's words that it has, 0.3 of its entities; at most 1."""
    share = lambda a, n: F.when(n > 0, a / n).otherwise(F.lit(0.0))
    within = let(F.lower(doc), lambda low: F.filter(phrases, lambda p: (F.length(p) > 3) & F.contains(low, F.lower(p))))
    first = share(F.size(within), F.size(phrases))
    second = share(F.size(F.array_intersect(words, doc_words)), F.size(words))
    third = share(F.size(F.array_intersect(things, doc_things)), F.size(things))
    return F.least(F.lit(1.0), 0.4 * first + 0.3 * second + 0.3 * third)


def is_contextless(q: Column) -> Column:
    pronoun = has_word(q, "|".join(PRONOUNS), "(?iu)")
    return q.rlike("(?iu)" + "|".join(CONTEXTLESS)) | (pronoun & (F.size(tokens(q)) < 10))


def has_reference(q: Column) -> Column:
    return q.rlike("(?iu)" + "|".join(REFERENCES))


def is_vague(q: Column) -> Column:
    specific = q.rlike(r"(?U)[A-Z][a-z]{2,}|\d|[a-z]{6,}")
    return q.rlike("(?iu)" + "|".join(VAGUE)) | (F.size(tokens(q)) < 6) | ~specific


def is_direct(q: Column, passage: Column) -> Column:
    """Whether the passage has the question word for word and, before or after it, an indicator phrase."""
    low = F.lower(passage)
    bare = F.lower(F.regexp_replace(clean(q), r"\?+$", ""))
    at = F.instr(low, bare)
    # the indicators are looked for in lower-cased text, so the two with a capital never match; they stay listed
    signs = F.array(*(F.lit(x) for x in INDICATORS))
    last = F.length(low) - F.instr(F.reverse(low), F.reverse(bare)) - F.length(bare) + 2
    before = F.exists(signs, lambda s: F.contains(F.substring(low, F.lit(1), last - 1), s))
    after = F.exists(signs, lambda s: F.contains(F.substring(low, at + F.length(bare), F.length(low)), s))
    return (at > 0) & (before | after)


def question_text(raw: Column) -> Column:
    """Trimmed, with a question mark and clean white space; null if there is nothing to ask."""
    t = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return F.when(~t.isin("", "?", "."), clean(F.when(F.endswith(t, F.lit("?")), t).otherwise(F.concat(t, F.lit("?")))))


def reject_reason(q: Column, passage: Column) -> Column:
    """The first filter that the question falls to, or 'kept'."""
    return (F.when(q.isNull(), F.lit("empty")).when(is_contextless(q), F.lit("contextless")).when(is_vague(q), F.lit("vague"))
            .when(has_reference(q), F.lit("passage_reference")).when(is_direct(q, passage), F.lit("direct")).otherwise(F.lit("kept")))


def sentence_score(s: Column, position: Column, count: Column) -> Column:
    """How much a sentence says: its length, names, numbers, question words, key verbs and its place."""
    n, names, low = F.size(tokens(s)), F.size(F.regexp_extract_all(s, F.lit("[A-Z][a-z]+"), F.lit(0))), F.lower(s)
    step = lambda x, two, one: F.when(x > two, 2).when(x > one, 1).otherwise(0)
    any_ = lambda ws: F.when(low.rlike("|".join(ws)), 1).otherwise(0)
    place = position / count
    return step(n, 15, 8) + step(names, 2, 0) + F.when(s.rlike(r"(?U)\d"), 1).otherwise(0) + any_(QUESTION_WORDS) + any_(KEY_VERBS) + F.when((place >= 0.25) & (place <= 0.75), 1).otherwise(0)


def fallback_question(passage: Column) -> Column:
    """A question from the passage's first two names, one name, or its longest sentence."""
    names = F.regexp_extract_all(passage, F.lit(r"(?U)\b[A-Z][a-z]{2,}\b"), F.lit(0))
    cut = sentences_after(clean(passage))
    longest = F.array_max(F.transform(cut, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    return (F.when(F.size(names) >= 2, F.concat(F.lit("How does this text relate "), F.get(names, 0), F.lit(" to "), F.get(names, 1), F.lit("?")))
            .when(F.size(names) == 1, F.concat(F.lit("What does this text say about "), F.get(names, 0), F.lit("?")))
            .otherwise(F.concat(F.lit("What is the main point about "), F.substring(longest, 1, 30), F.lit("...?"))))


def keep_line(line: Column) -> Column:
    """Whether a line of page text is content: three characters, half of them letters, no short navigation text."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (F.length(line) >= 3) & (letters >= 0.5 * F.length(line)) & ~(F.lower(line).rlike("|".join(NAVIGATION)) & (F.length(line) < 50))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(scheme, network place, path) by the shape of the string, without failing on any."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 3)


def is_url(url: Column) -> Column:
    scheme, place, _ = url_parts(url)
    return F.coalesce(scheme.isin("http", "https") & (place != ""), F.lit(False))


def url_filename(url: Column) -> Column:
    _, place, path = url_parts(url)
    name = F.substring(F.regexp_replace(F.concat(place, path), r'[<>:"/\\|?*]', "_"), 1, 100)
    return F.when(name.isin("", "_"), F.lit("webpage")).otherwise(name)


def verdict(response: Column) -> Column:
    """A fact-checker's reply: struct(valid, confidence, issues). The last line of each kind counts."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    last = lambda key: F.element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(key))), -1)
    has = lambda key: F.exists(lines, lambda x: F.startswith(x, F.lit(key)))
    number = F.trim(F.get(F.split(last("Confidence:"), ":"), 1)).try_cast("double")
    listed = F.trim(F.regexp_replace(last("Issues:"), "^Issues:", ""))
    issues = F.filter(F.transform(F.split(listed, ";"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(has("Valid:"), F.contains(F.lower(last("Valid:")), F.lit("yes"))).otherwise(F.lit(True)).alias("valid"),
        F.when(has("Confidence:"), F.coalesce(number, F.lit(0.5))).otherwise(F.lit(0.8)).alias("confidence"),
        F.when(has("Issues:") & (F.lower(listed) != "none"), issues).otherwise(none).alias("issues"),
    )


def numeric_score(response: Column) -> Column:
    """The first number in a reply, as a share: over 1 it's a percentage; without one, a hundredth of the length; at most 1."""
    t = F.trim(response)
    number = F.nullif(F.regexp_extract(t, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    share = F.when(number > 1, number / 100).otherwise(number)
    by_length = F.least(F.lit(1.0), F.length(t) / 100.0)
    return F.when(share.isNotNull(), F.least(F.lit(1.0), share)).when(t.isNotNull(), by_length).otherwise(F.lit(0.5))


def cleaned_answer(raw: Column, compat: bool = True) -> Column:
    """A local model's reply: cut at the first listed stop pattern that occurs, odd characters and artifacts out, whole sentences.

    compat: also cut at any word that begins with 'ame', as the original rule does.
    """
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    t = trim(raw)
    cut = F.lit(None).cast("string")
    for p in reversed(STOPS):
        cut = F.when(t.rlike(f"(?iu){p}"), trim(F.get(F.split(t, f"(?iu){p}", 2), 0))).otherwise(cut)
    t = F.coalesce(cut, t)
    for pattern, by in ((r"\.{3,}", "."), (r"\.{2,}$", "."), (r"\n\s*\.\s*\n", "\n"), (r"(?U)\s+", " "), (r"[^\x00-\x7F]+", ""), (r"[^\w\s.,!?;:\-'\"()]+", "")):
        t = F.regexp_replace(t, pattern, by)
    for p in ARTIFACTS if compat else ARTIFACTS[1:]:
        t = F.regexp_replace(t, f"(?isu){p}", "")
    t = trim(t)
    parts = F.split(t, "[.!?]+")
    whole = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), ". "), F.lit("."))
    return trim(F.when((t != "") & ~t.rlike("[.!?]$") & (F.size(parts) > 1), whole).otherwise(t))


def preview(text: Column, n: int) -> Column:
    """The first n characters on one line, with an ellipsis if there are more. A display column: the text itself stays whole."""
    return F.concat(F.translate(F.substring(text, 1, n), "\n", " "), F.when(F.length(text) > n, F.lit("...")).otherwise(F.lit("")))
