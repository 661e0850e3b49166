"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block matches a license template when it holds at least ``threshold`` of the
template's distinct words. Blocks are overlapping runs of a text's words, whatever its
lines: a template of up to half of a size in ``RUNS`` meets runs of that size, which start
every half of it, so that wherever the template stands, some run holds all of it.

Words are ordered by their number of texts in the whole corpus, rare first. A match must hold
one of the template's first ``size - ceil(threshold * size) + 1`` words (prefix filter),
have enough template words at all (length filter), and enough of them from the shared prefix
word on, on both sides (positional filter). What is left is counted exactly. Sizes of runs go
on in steps of four as far as the longest template asks.

Templates of up to ``LITERALS`` distinct words in all, as those of this module, are literals of
the plan; blocks meet their prefix index in an equi-join on words and carry only their template
words. More of them are a table: their words are ordered by a join with the texts' words, texts
meet the prefix index by their distinct words, and each text that shares a prefix word with a
template is counted, run by run, against that template alone (``similar_by_joins``).

The documents are read once: that pass finds the phrases and the template words of each whole
text, and keeps the words themselves only where the whole text holds enough of some template,
without which no block can. The phrases' labels are kept beside the join's.

Null and empty texts have no words and score 0. Repeated rows (same id and text) have equal
results, once per row. A null id keeps its rows. A very long text takes memory of a few
times its size, in its task alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize

THRESHOLD, RUNS, LITERALS = 0.8, (8, 32, 128), 2000

# Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Templates of the similarity join: label -> words of the license or its notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: F.Column) -> F.Column:
    """A-Z lowered. Of other characters only two have ASCII letters in their lower case;
    where neither occurs the engine's faster lower() splits into the same ASCII words."""
    return F.when(text.rlike("[İK]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _spaced(text: F.Column) -> F.Column:
    """The words with one space between."""
    return F.trim(F.regexp_replace(_lowered(text), SEPARATORS, " "))


def _spaces(s: F.Column) -> F.Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _sizes(templates) -> tuple[int, ...]:
    """Of runs: four times the size before, until half of one holds the longest template."""
    sizes, longest = list(RUNS), max((len(sentence.split()) for _, sentence in templates), default=0)
    while sizes[-1] // 2 < longest:
        sizes.append(4 * sizes[-1])
    return tuple(sizes)


def _entries(threshold: float, templates) -> list[tuple[int, str, list[str], int, int]]:
    """(template, label, distinct words, how many a match holds, size of its runs); a template
    without words matches nothing."""
    out, sizes = [], _sizes(templates)
    for i, (label, sentence) in enumerate(templates):
        words = sentence.split()
        if words:
            out.append((i, label, sorted(set(words)), math.ceil(threshold * len(set(words)) - 1e-9), next(s for s in sizes if len(words) <= s // 2)))
    return out


def _literals(words: list[str]) -> F.Column:
    return F.array(*map(F.lit, words))


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, sentence in templates for w in sentence.split()})


def phrase_columns(spaced: F.Column) -> dict[str, F.Column]:
    """Of each phrase: places, smallest and largest start."""
    padded = F.concat(F.lit(" "), spaced, F.lit(" "))
    words = F.when(F.length(spaced) == 0, F.lit(0).cast("long")).otherwise(_spaces(spaced) + 1)
    out = {"n_words": words}
    for phrase, label in PHRASES.items():
        inner, n = F.lit(f" {phrase} "), len(phrase.split())
        found = F.contains(padded, inner)
        out[f"n {label}"] = F.when(found, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long"))
        out[f"first {label}"] = F.when(found, _spaces(F.substring_index(padded, f" {phrase} ", 1)))
        out[f"last {label}"] = F.when(found, words - _spaces(F.substring_index(padded, f" {phrase} ", -1)) - n)
    return out


def _order(rows: DataFrame, templates) -> list[str]:
    """The template words by their number of texts; at most ``LITERALS`` rows come to the driver."""
    counts = {r["w"]: r["n"] for r in rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(_vocabulary(templates), key=lambda w: (counts.get(w, 0), w))


def _starts(words: F.Column, half: F.Column) -> F.Column:
    """A run starts at every half of its size while words are left that the run before does
    not hold."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - half - 1, F.lit(0)), half)


def _runs(words: F.Column, size: int, vocabulary: list[str]) -> F.Column:
    """The template words of each run."""
    return F.transform(_starts(words, F.lit(size // 2)), lambda i: F.array_intersect(F.slice(words, i + 1, F.lit(size)), _literals(vocabulary)))


def similar_by_joins(rows: DataFrame, threshold: float, templates) -> DataFrame:
    """The same as ``similar_blocks`` for any number of templates; ``rows``: key, all (words)."""
    spark = rows.sparkSession
    entries = spark.createDataFrame(_entries(threshold, templates), "template int, label string, members array<string>, need int, run int")
    rows = rows.dropDuplicates(["key"])
    words = rows.select("key", F.explode(F.array_distinct("all")).alias("w"))
    asked = entries.select("template", "need", F.size("members").alias("size"), F.explode("members").alias("w"))
    met = materialize(words.join(asked.select("w").distinct(), "w"))
    order = asked.join(met.groupBy("w").agg(F.count("*").alias("n")), "w", "left")
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "w"))
    prefix = order.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.col("need") + 1).select("w", "template")
    pairs = met.join(prefix, "w").select("key", "template").distinct().join(entries, "template").join(rows, "key")
    words = F.col("all")
    overlaps = F.transform(_starts(words, (F.col("run") / 2).cast("int")), lambda i: F.size(F.array_intersect(F.slice(words, i + 1, F.col("run")), F.col("members"))))
    found = pairs.select("key", "template", "label", "need", F.size("members").alias("size"), F.array_max(overlaps).alias("overlap"))
    return found.where("overlap >= need").select("key", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def similar_blocks(rows: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``key, template, label, containment``: templates that some block of ``rows`` (key,
    held, words) meets, with the best containment."""
    spark, entries, sizes, vocabulary = rows.sparkSession, _entries(threshold, templates), _sizes(templates), _vocabulary(templates)
    place = {w: k for k, w in enumerate(_order(rows, templates))}
    prefix = []
    for i, label, words, need, size in entries:
        ordered = sorted(words, key=place.get)
        prefix += [(size, w, at, i, label, ordered, need) for at, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = spark.createDataFrame(prefix, "run int, w string, at int, template int, label string, members array<string>, need int")
    found = rows.where("words is not null").select("key", "words")
    blocks = reduce(DataFrame.unionByName, (found.select("key", F.lit(size).alias("run"), F.explode(_runs(F.col("words"), size, vocabulary)).alias("words")) for size in sizes))
    least = reduce(F.least, [F.lit(10**6), *(F.when(F.col("run") == size, min((need for *_, need, s in entries if s == size), default=10**6)) for size in sizes)])
    ordered = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(F.create_map(*(x for k, v in place.items() for x in (F.lit(k), F.lit(v)))), w).alias("k"), w.alias("w")))), lambda o: o["w"])
    sides = blocks.where(F.size("words") >= least).distinct().select("key", "run", ordered.alias("words"))
    probes = sides.select("key", "run", "words", F.posexplode("words").alias("pos", "w"))
    met = probes.join(index, ["run", "w"]).where(
        (F.size("words") >= F.col("need"))  # length
        & (1 + F.least(F.size("members") - F.col("at") - 1, F.size("words") - F.col("pos") - 1) + F.least("at", "pos") >= F.col("need"))  # position
    )
    overlap = F.size(F.array_intersect("words", "members"))
    held = met.select("key", "template", "label", (overlap / F.size("members")).alias("containment"), overlap.alias("overlap"), "need")
    return held.where("overlap >= need").groupBy("key", "template", "label").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    ``templates``: (label, words with a space between, lower case), any number of any length."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))
    rows = rows.select("doc_id", key.alias("key"), _spaced(F.col("text")).alias("spaced"))
    rows = rows.select("*", F.split("spaced", " ").alias("all"))
    cols = phrase_columns(F.col("spaced"))
    some = [c.alias(n) for n, c in cols.items()]
    vocabulary = _vocabulary(templates)
    if len(vocabulary) <= LITERALS:
        rows = rows.select("*", F.array_intersect("all", _literals(vocabulary)).alias("held"))
        enough = reduce(lambda a, b: a | b, (F.size(F.array_intersect("held", _literals(words))) >= need for _, _, words, need, _ in _entries(threshold, templates)), F.lit(False))
        one = materialize(rows.select("doc_id", "key", "held", *some, F.when(enough, F.col("all")).alias("words")))
        similar = similar_blocks(one, threshold, templates)
    else:
        one = materialize(rows.select("doc_id", "key", "all", *some))
        similar = similar_by_joins(one.select("key", "all"), threshold, templates)
    labels = sorted(set(PHRASES.values()))
    total = reduce(lambda a, b: a + b, (F.col(f"n {x}") for x in labels))
    base = one.select("doc_id", "key", "n_words", total.alias("n_base"), F.least(*(F.col(f"first {x}") for x in labels)).alias("first_word"), F.greatest(*(F.col(f"last {x}") for x in labels)).alias("last_word"), F.array_compact(F.array(*(F.when(F.col(f"n {x}") > 0, F.lit(x)) for x in labels))).alias("base"))
    best = similar.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.join(best.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2"), "left")
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL: every run against every template of its size, no filters."""
    spaced = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    values = ", ".join(f"({size}, '{label}', {words}, {need})" for _, label, words, need, size in _entries(threshold, TEMPLATES))
    runs = " UNION ALL ".join(f"SELECT k, {s} AS run, list_distinct(ws[i + 1 : i + {s}]) AS ws FROM (SELECT k, ws, unnest(range(0, greatest(len(ws) - {s // 2}, 1), {s // 2})) AS i FROM w)" for s in RUNS)
    parts = []
    for phrase, label in PHRASES.items():
        k = len(phrase.split())
        parts.append(f"SELECT k, '{label}' AS label, p FROM (SELECT k, ws, unnest(range(len(ws) - {k} + 1)) AS p FROM w WHERE len(ws) >= {k} AND contains(' ' || sp || ' ', ' {phrase} ')) WHERE array_to_string(ws[p + 1 : p + {k}], ' ') = '{phrase}'")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, sp, CASE WHEN sp = '' THEN [] ELSE string_split(sp, ' ') END AS ws FROM (SELECT k, {spaced('t')} AS sp FROM d)),
hits AS ({' UNION ALL '.join(parts)}),
b AS (SELECT k, count(*) AS n, min(p) AS a, max(p) AS z, list_sort(list(DISTINCT label)) AS l FROM hits GROUP BY k),
runs AS ({runs}),
tpl(run, label, ts, need) AS (VALUES {values}),
sim AS (SELECT k, label, len(list_intersect(ws, ts)) / len(ts) AS c FROM runs JOIN tpl USING (run) WHERE len(list_intersect(ws, ts)) >= need),
m AS (SELECT k, list(DISTINCT label) AS l, max(c) AS c FROM sim GROUP BY k)
SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word,
  coalesce(array_to_string(b.l, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ','), '') AS labels,
  CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.c, 0.0) END AS DOUBLE) AS score
FROM d JOIN w USING (k) LEFT JOIN b USING (k) LEFT JOIN m USING (k)"""
