"""License scans by diagonal voting: k-grams of words joined to template positions, voted by offset. DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, join_skewed, packed, saved, table, unpacked

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: What public license notices say, and the label of each.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _run(i: Column, k: int) -> Column:
    """The hash of the k words from place i of _tz_words."""
    return F.xxhash64(*(F.get("_tz_words", i + j) for j in range(k)))


def _known(spark: SparkSession, k: int) -> DataFrame:
    """(t, tpos, gram): the runs of k words of the templates, a few hundred whatever the documents."""
    rows = [(i, template_words(text)) for i, (_, text) in enumerate(TEMPLATES)]
    listed = F.array(*(F.struct(F.lit(i).alias("t"), F.array(*map(F.lit, ws)).alias("_tz_words")) for i, ws in rows if len(ws) >= k))
    runs = spark.range(1).select(F.inline(listed)).select("t", "_tz_words", F.explode(F.sequence(F.lit(0), F.size("_tz_words") - k)).alias("tpos"))
    return runs.select("t", "tpos", _run(F.col("tpos"), k).alias("gram"))


def _candidates(hits: DataFrame, known: DataFrame, k: int, min_votes: float) -> DataFrame:
    """(_tz_h1, _tz_h2, _tz_found): for each text with enough votes in one band, its bands (template, diagonals, extent), by stretch of _longest() words."""
    sizes = F.array(*(F.lit(len(template_words(text))) for _, text in TEMPLATES))
    text = ["_tz_h1", "_tz_h2"]
    votes = hits.select(*text, F.explode("_tz_hits").alias("x")).select(*text, "x.*").join(F.broadcast(known), "gram")
    lines = votes.groupBy(*text, "t", (F.col("pos") - F.col("tpos")).alias("d")).agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lines = lines.withColumn("size", F.get(sizes, F.col("t"))).withColumn("slack", F.greatest(F.lit(2), F.floor(F.col("size") / 8)))
    order = W.partitionBy(*text, "t").orderBy("d")
    lines = lines.withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(order) > F.col("slack")).cast("int"), F.lit(1))).withColumn("band", F.sum("new").over(order))
    line = F.struct("d", "lo", "hi", "at")
    bands = lines.groupBy(*text, "t", "size", "slack", "band").agg(F.array_sort(F.collect_list(line)).alias("own"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    one = lambda x, ds: F.struct(ds.alias("ds"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.size(x["at"]).alias("votes"))
    every = F.struct(F.transform("own", lambda x: x["d"]).alias("ds"), "lo", "hi", F.size(F.array_distinct(F.flatten(F.transform("own", lambda x: x["at"])))).alias("votes"))
    fits = F.col("hi") + k - F.col("lo") <= 1.25 * F.col("size") + F.col("slack")
    parts = F.when(fits, F.array(every)).otherwise(F.transform("own", lambda x: one(x, F.array(x["d"]))))
    found = bands.select(*text, "t", "size", F.explode(parts).alias("x")).select(*text, "t", "size", "x.*")
    sound = found.filter(F.col("votes") >= min_votes * (F.col("size") - k + 1))
    dealt = sound.groupBy(*text, F.floor(F.col("lo") / _longest(k)).alias("at")).agg(F.collect_list(F.struct("t", "lo", "hi", "ds")).alias("own"))
    return dealt.groupBy(*text).agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("_tz_found"))


def _longest(k: int) -> int:
    """No band is longer, in words: see _candidates()."""
    size = max(len(template_words(text)) for _, text in TEMPLATES)
    return int(1.25 * size) + max(2, size // 8) + k


def _verified(met: DataFrame, k: int, min_share: float) -> DataFrame:
    """met with _tz_spans: the spans of _tz_found whose words are the template's, of overlapping ones the best.

    Overlapping spans begin in the same stretch of a text or in neighbouring ones, so each is held against those only: the work grows with the text.
    """
    said = F.array(*(F.array(*map(F.lit, template_words(text))) for _, text in TEMPLATES))
    labels = F.array(*(F.lit(label) for label, _ in TEMPLATES))

    def check(x: Column) -> Column:  # the words are named twice: an expression named once would be put in its place, and worked out for each x
        template = F.get(said, x["t"])
        same = F.filter(F.sequence(F.lit(0), F.size(template) - 1), lambda j: F.exists(x["ds"], lambda d: (j + d < F.size("_tz_words")) & (F.get("_tz_words", (j + d).cast("int")) == F.get(template, j))))
        share = F.size(same) / F.size(template)
        return F.struct(share.alias("share"), F.size(template).alias("size"), (-x["t"]).alias("t"), x["lo"].alias("lo"), (x["hi"] + k - 1).alias("hi"))

    own = lambda b: F.filter(F.transform(b["own"], check), lambda x: x["share"] >= min_share)
    met = met.withColumn("_tz_checked", F.transform("_tz_found", lambda b: F.struct(b["at"].alias("at"), own(b).alias("own"))))
    beaten = lambda x, all_: F.exists(all_, lambda y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"]) & (y > x))

    def best(b: Column, i: Column) -> Column:
        sides = [(F.get("_tz_checked", i + n), n) for n in (-1, 1)]
        by_side = lambda x: reduce(or_, (F.coalesce((o["at"] == b["at"] + n) & beaten(x, o["own"]), F.lit(False)) for o, n in sides))
        return F.filter(b["own"], lambda x: ~beaten(x, b["own"]) & ~by_side(x))

    span = lambda x: F.struct(F.get(labels, -x["t"]).alias("label"), x["lo"].cast("long").alias("first_word"), x["hi"].cast("long").alias("last_word"), x["share"].alias("share"))
    met = met.withColumn("_tz_sorted", F.array_sort(F.transform(F.flatten(F.transform("_tz_checked", best)), span)))
    # alike ones stand beside each other; array_distinct() holds each struct against all others
    return met.withColumn("_tz_spans", F.filter("_tz_sorted", lambda x, i: (i == 0) | (x != F.get("_tz_sorted", i - 1))))


def license_scan(docs: DataFrame, k: int = 4, min_votes: float = 0.3, min_share: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Runs of k words are joined to the templates' and vote by text and diagonal (place in the text less place in the
    template). Neighbouring diagonals (words left out or put in; no further apart than an eighth of the template, or 2)
    are one band; if that is longer than the template and a quarter, its diagonals stand alone. A band with votes from at
    least min_votes of the template's runs is verified word by word: min_share of the template's words must stand on one
    of its diagonals. Of overlapping spans the one of the largest share stays, then of the longer template, then of the
    first. spans: array of (label, first_word, last_word, share). score: the largest share, or 0.5 if there is only a
    base phrase, else 0.

    Null text: no words, empty strings, 0 and null places. Rows alike in text get the same result. Empty input: empty
    output. Columns of the names made here are replaced. The templates are a fixed list, whose few hundred runs are
    broadcast. Texts are read once and aren't shuffled but for those with a run of a template; these go by two hashes
    of the text, and hot ones (copies) by join_skewed().
    """
    spark = docs.sparkSession
    known = _known(spark, k)
    runs = sorted(r.gram for r in known.select("gram").distinct().collect())
    starts = sorted({w for _, text in TEMPLATES for w in template_words(text)})
    base = packed(docs, text_col, beside=text_col).select("_tz_row", ascii_lower(F.coalesce(F.col(f"_tz_{text_col}").cast("string"), F.lit(""))).alias("_tz_low"))
    split = base.withColumn("_tz_words", F.array_remove(F.split("_tz_low", BREAKS), ""))
    n, none = F.size("_tz_words"), F.array().cast("array<int>")

    # base phrases: only texts that hold a phrase's words at all are looked through
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    holds = reduce(or_, (reduce(and_, (F.contains("_tz_low", F.lit(w)) for w in ws)) for ws, _ in phrases))
    heads = [ws[0] for ws, _ in phrases]
    split = split.withColumn("_tz_heads", F.when(holds & (n > 0), F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("_tz_words", i).isin(heads))).otherwise(none))
    standing = lambda ws: F.filter("_tz_heads", lambda i: reduce(and_, (F.get("_tz_words", i + j) == w for j, w in enumerate(ws))))
    places = [standing(ws) for ws, _ in phrases]
    at = F.filter(F.sequence(F.lit(0), n - k), lambda i: F.get("_tz_words", i).isin(starts) & F.get("_tz_words", i + k - 1).isin(starts))
    hits = F.filter(F.transform(at, lambda i: F.struct(i.alias("pos"), _run(i, k).alias("gram"))), lambda x: x["gram"].isin(runs))
    split = split.withColumn("_tz_places", F.array(*places)).withColumn("_tz_hits", F.when(n >= k, hits))
    named = F.array_compact(F.transform(F.array(*(F.lit(label) for _, label in phrases)), lambda x, i: F.when(F.size(F.get("_tz_places", i)) > 0, x)))
    every, voted = F.flatten("_tz_places"), F.size("_tz_hits") > 0
    made = saved(split.select(
        "_tz_row", n.cast("long").alias("_tz_n"), F.size(every).cast("long").alias("_tz_base"), F.array_min(every).cast("long").alias("_tz_first"), F.array_max(every).cast("long").alias("_tz_last"),
        F.array_sort(named).alias("_tz_base_labels"), *(F.when(voted, c).alias(a) for c, a in ((F.col("_tz_hits"), "_tz_hits"), (F.col("_tz_low"), "_tz_low"), (F.xxhash64("_tz_low"), "_tz_h1"), (F.xxhash64(F.lit(1), "_tz_low"), "_tz_h2"))),
    ))

    some = made.filter("_tz_hits is not null")
    found = _candidates(some, known, k, min_votes)
    texts = some.groupBy("_tz_h1", "_tz_h2").agg(F.count("*").alias("_tz_rows")).join(found, ["_tz_h1", "_tz_h2"], "left")
    met = join_skewed(some.drop("_tz_hits"), saved(texts), ["_tz_h1", "_tz_h2"], "_tz_rows", ["_tz_found"])
    met = met.withColumn("_tz_words", F.when(F.col("_tz_found").isNotNull(), F.array_remove(F.split("_tz_low", BREAKS), "")))
    met = _verified(met, k, min_share)
    no_spans = F.array().cast(met.schema["_tz_spans"].dataType)
    columns = ["_tz_row", "_tz_n", "_tz_base", "_tz_first", "_tz_last", "_tz_base_labels"]
    out = made.filter("_tz_hits is null").select(*columns, no_spans.alias("_tz_spans")).unionByName(met.select(*columns, F.coalesce("_tz_spans", no_spans).alias("_tz_spans")))
    all_ = F.array_sort(F.array_union("_tz_base_labels", F.transform("_tz_spans", lambda x: x["label"])))
    share = F.coalesce(F.array_max(F.transform("_tz_spans", lambda x: x["share"])), F.when(F.col("_tz_base") > 0, F.lit(0.5)), F.lit(0.0))
    return unpacked(out, docs, text_col, n_words=F.col("_tz_n"), n_base=F.col("_tz_base"), first_word=F.col("_tz_first"), last_word=F.col("_tz_last"),
                    base_labels=F.array_join("_tz_base_labels", ","), labels=F.array_join(all_, ","), score=share, spans=F.col("_tz_spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
