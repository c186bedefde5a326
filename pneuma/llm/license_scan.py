"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word 3-grams are hashed and joined to the places of the same hashes in
a table of license templates. A hit votes for its diagonal (place in the text less place in
the template). Diagonals at most ``GAP`` apart merge around the one with most votes, so that a few added
or missing words do not split a span. A merged span with enough votes is verified: its words
are compared with the template's by edit distance, and it is a license span if the similarity
``1 - distance / longer length`` is ``MIN_SIMILARITY`` or more.

Template hashes also stand as a constant set in the scan, which keeps the positions that the
join can match; templates are a bounded table (``MAX_TEMPLATE_GRAMS``, checked).

Null text is empty. Every row gets a row, repeated rows as well. Fewer than three words have
no gram, but their base phrases count. Ties between diagonals go to the smallest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

K = 3
GAP = 3
MIN_SIMILARITY = 0.8
MAX_TEMPLATE_GRAMS = 100_000
#: Distinct words that one template may have: each gets a printable character.
MAX_TEMPLATE_WORDS = 90
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases of the contract with their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Public license notices, with the label of each.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                   "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                   "later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
                 "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """Words between separators, without the empty ones that a separator at either end leaves."""
    parts = F.split(lower_ascii(text), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(K)))


def _places(words: Column, width: int, test) -> Column:
    """Ascending positions at which ``width`` words begin that pass ``test``; null where there are fewer words."""
    n = F.size(words)
    return F.when(n >= width, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(width)) - width), test))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """template, label, words, vocabulary, code (one character per word), n of every template."""
    rows = list(enumerate(TEMPLATES if templates is None else templates))
    t = spark.createDataFrame([(i, label, text) for i, (label, text) in rows], "template int, label string, text string")
    t = t.select("template", "label", words_of(F.col("text")).alias("words"))
    t = t.withColumns({"vocabulary": F.array_distinct("words"), "n": F.size("words")})
    return t.withColumn("code", encoded(F.col("words"), F.col("vocabulary")))


def encoded(words: Column, vocabulary: Column) -> Column:
    """One printable character per word: its place in the vocabulary, a blank for any other word."""
    return F.array_join(F.transform(words, lambda w: F.char(F.array_position(vocabulary, w) + 32)), "")


def template_grams(templates: DataFrame) -> DataFrame:
    """h, template, tpos: every place of every 3-gram of the templates."""
    places = templates.select("template", "words", F.explode(F.sequence(F.lit(0), F.col("n") - K)).alias("tpos"))
    return places.select(gram(F.col("words"), F.col("tpos")).alias("h"), "template", "tpos")


def _checked(templates: DataFrame) -> list[int]:
    """The distinct hashes of the templates, which bound the constant set and the broadcast."""
    size = templates.agg(F.min("n").alias("least"), F.sum("n").alias("all"), F.max(F.size("vocabulary")).alias("words")).first()
    if size["least"] is not None and (size["least"] < K or size["all"] > MAX_TEMPLATE_GRAMS or size["words"] > MAX_TEMPLATE_WORDS):
        raise ValueError(f"templates need {K} words or more, {MAX_TEMPLATE_WORDS} distinct words or fewer, "
                         f"and {MAX_TEMPLATE_GRAMS} words or fewer in all")
    return [r["h"] for r in template_grams(templates).select("h").distinct().collect()]


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per row of ``docs``, from one pass over the texts.

    id (of the row), doc_id, n_words, base (start and label of every base phrase), hits (pos, h), and ``near``, the words
    from the first hit to the last, which begin at word ``lo``.
    """
    hashes = _checked(templates)
    w = F.col("words")
    src = docs.select(F.monotonically_increasing_id().alias("id"), docs["doc_id"].cast("long").alias("doc_id"),
                      words_of(docs["text"]).alias("words"))

    def holds(i: Column, phrase: str) -> Column:
        test = F.lit(True)
        for j, x in enumerate(phrase.split()):
            test = test & (F.get(w, i + j) == x)
        return test

    def any_base(i: Column) -> Column:
        test = F.lit(False)
        for phrase, _ in BASE:
            test = test | holds(i, phrase)
        return F.coalesce(test, F.lit(False))

    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE:
            out = F.when(F.get(w, i) == phrase.split()[0], name).otherwise(out)
        return F.struct(i.alias("start"), out.alias("label"))

    may = F.array_contains(w, "license") | F.array_contains(w, "cc")
    src = src.withColumns({
        "base": F.when(may, F.transform(_places(w, 2, any_base), label)),
        "pos": _places(w, K, lambda i: gram(w, i).isin(hashes)) if hashes else F.lit(None).cast("array<int>")})
    first, last = F.get("pos", F.lit(0)), F.element_at("pos", -1)
    has = F.size("pos") > 0
    rows = src.select(
        "id", "doc_id", F.size("words").cast("long").alias("n_words"), "base",
        F.when(has, F.transform("pos", lambda i: F.struct(i.alias("pos"), gram(w, i).alias("h")))).alias("hits"),
        F.when(has, first).alias("lo"), F.when(has, F.slice("words", first + 1, last - first + K)).alias("near"))
    return materialize(rows, "licenses")


def diagonals(scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """id, template, diagonal, votes, first, last: hits of all texts joined to the templates' places, per diagonal."""
    hits = scanned.where("hits is not null").select("id", F.inline("hits"))
    met = hits.join(F.broadcast(template_grams(templates)), "h")  # MAX_TEMPLATE_GRAMS rows at most
    return met.groupBy("id", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def merged(diags: DataFrame) -> DataFrame:
    """id, template, votes, start, end: each diagonal that leads its neighbourhood, with the neighbours' votes and reach."""
    near = Window.partitionBy("id", "template").orderBy("diagonal").rangeBetween(-GAP, GAP)
    rank = F.struct("votes", (-F.col("diagonal")).alias("low"))
    lead = diags.withColumns({"_lead": F.max(rank).over(near), "_votes": F.sum("votes").over(near),
                              "start": F.min("first").over(near), "end": F.max("last").over(near) + K})
    return lead.where(F.col("_lead.low") == -F.col("diagonal")).select("id", "template", F.col("_votes").alias("votes"), "start", "end")


def spans(scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """id, doc_id, label, template, start, end (words), votes, similarity: the verified license spans.

    A span within the similarity keeps at least a quarter of the template's words less two in matching 3-grams,
    so fewer votes need no comparison.
    """
    facts = F.broadcast(templates.select("template", "label", "vocabulary", "code", "n"))  # bounded as the hashes are
    found = merged(diagonals(scanned, templates)).join(facts, "template").where(F.col("votes") >= F.ceil(F.col("n") / 4) - 2)
    both = found.join(scanned.where("hits is not null").select("id", "doc_id", "lo", "near"), "id")
    mine = encoded(F.slice("near", F.col("start") - F.col("lo") + 1, F.col("end") - F.col("start")), F.col("vocabulary"))
    length = F.greatest(F.col("end") - F.col("start"), F.col("n"))
    return (both.withColumn("similarity", (length - F.levenshtein(mine, F.col("code"))) / length)
            .where(F.col("similarity") >= MIN_SIMILARITY)
            .select("id", "doc_id", "label", "template", "start", "end", "votes", "similarity"))


def report(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """One row per scanned row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    ``score`` is the best similarity of a verified span, 0 without one.
    """
    per = found.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max("similarity").alias("best"),
                                  F.count(F.lit(1)).alias("n_spans"))
    base = F.coalesce(F.col("base"), F.array().cast("array<struct<start:int,label:string>>"))
    starts, names = F.transform(base, lambda b: b["start"]), F.array_distinct(F.transform(base, lambda b: b["label"]))
    every = F.array_union(names, F.coalesce(F.col("own"), F.array().cast("array<string>")))
    return (scanned.select("id", "doc_id", "n_words", "base").join(per, "id", "left").select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans")))


def license_report(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``report`` of ``docs`` with the given or the built-in templates."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    scanned = scan(docs, templates)
    return report(scanned, spans(scanned, templates))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    base = " UNION ALL ".join(
        f"SELECT id, pos, '{label}' AS label FROM g WHERE " + " AND ".join(f"w[pos + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))
        for p, label in BASE)
    code = "array_to_string([chr((coalesce(list_position(%s, x), 0) + 32)::INTEGER) FOR x IN %s], '')"
    return f"""
WITH t0(template, label, text) AS (VALUES {values}),
t AS (SELECT template, label, regexp_extract_all({low % 'text'}, '{word}') AS w FROM t0),
tg AS (SELECT template, label, w, unnest(range(0, len(w) - {K - 1})) AS tpos FROM t),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({low % "coalesce(text, '')"}, '{word}') AS w FROM documents),
g AS (SELECT id, w, unnest(range(0, len(w))) AS pos FROM d),
base AS ({base}),
hits AS (SELECT g.id, g.pos, tg.template, tg.tpos FROM g JOIN tg ON g.w[pos + 1] = tg.w[tpos + 1] AND g.w[pos + 2] = tg.w[tpos + 2]
           AND g.w[pos + 3] = tg.w[tpos + 3]),
diag AS (SELECT id, template, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) AS last FROM hits GROUP BY ALL),
near AS (SELECT *, max(votes * 1000000000 - diagonal) OVER n AS lead, sum(votes) OVER n AS all_votes, min(first) OVER n AS s,
           max(last) OVER n + {K} AS e
         FROM diag WINDOW n AS (PARTITION BY id, template ORDER BY diagonal RANGE BETWEEN {GAP} PRECEDING AND {GAP} FOLLOWING)),
sp AS (SELECT near.id, t.label, greatest(e - s, len(t.w)) AS n,
         levenshtein({code % ('list_distinct_in_order', 'd.w[s + 1:e]')}, {code % ('list_distinct_in_order', 't.w')}) AS lev
       FROM near JOIN t USING (template) JOIN d ON d.id = near.id
       WHERE lead = votes * 1000000000 - diagonal AND all_votes >= ceil(len(t.w) / 4.0) - 2),
per AS (SELECT id, list(DISTINCT label) AS own, max((n - lev) / n) AS best, count(*) AS n_spans FROM sp
        WHERE (n - lev) / n >= {MIN_SIMILARITY} GROUP BY id),
b AS (SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS names FROM base GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(names, []) || coalesce(own, []))), ',') AS labels,
  coalesce(best, 0.0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN b USING (id) LEFT JOIN per USING (id)
""".replace("list_distinct_in_order", "t.w")  # the first place of a word in the template names it


ORACLE = _sql()
