"""Operator 9 [native]: license scan by an exact set-similarity join.

Blocks are the lines of a text and, for notices broken over lines, its windows of as many words as a template
has (see wrapped); a block's set is its words. Template words are ordered by how many documents have them, rarest
first, counted over all documents. A template is found in a block that holds at least `threshold` of its words; by
the prefix filter one of the template's first words in that order is one of the block's first, by the length filter
it has enough words, by the positional filter enough are left after the shared one. What is left is
verified on whole sets; a block gets the labels of all templates it meets, save one whose words in the block
are all words of a rival that the block holds a larger share of (gpl-2 beside gpl-3). Base phrases are counted beside that.
One pass over all texts tells which hold enough of a template's words at all; only these are cut into blocks.
DataFrame functions only.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

# Phrases and their labels, then notices of common licenses.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this library is free software licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
]
#: What stands between words of the contract's alphabet, before letters are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; other letters stay as they are."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), GAP, -1), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def phrase_starts(found: Column, phrase: str) -> Column:
    """The places in an array of words where the phrase's words stand."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        tests = [F.get(found, i + k) == w for k, w in enumerate(parts)]
        out = tests[0]
        for t in tests[1:]:
            out = out & F.coalesce(t, F.lit(False))
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(found) - 1), here)


def needed(text: str, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return math.ceil(round(threshold * len(set(text.split())), 9))


def survey(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each document: _id, _hash, _bytes, n_words, held (vocabulary words) and the text, if it may hold a phrase or a template."""
    vocabulary = sorted({w for t, _ in (*templates, *PHRASES) for w in t.split()})
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_words", words(F.col("_text")))
    rows = rows.select("_id", F.xxhash64("_text").alias("_hash"), F.octet_length("_text").alias("_bytes"), F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", strings(vocabulary)).alias("held"), "_text")
    wanted = [(sorted(set(t.split())), needed(t, threshold)) for t, _ in templates] + [(sorted(set(p.split())), len(set(p.split()))) for p, _ in PHRASES]
    enough = F.lit(False)
    for own, least in wanted:
        enough = enough | (F.size(F.array_intersect("held", strings(own))) >= least)
    few = min(least for _, least in wanted)
    return rows.withColumn("_text", F.when((F.size("held") >= few) & enough, F.col("_text")))


def block_hits(found: DataFrame, keys: list[str], vocabulary: list[str]) -> DataFrame:
    """A row for each line with a template word: keys, block, n (its set's size) and hits, those words of its set."""
    blocks = found.select(*keys, F.posexplode(F.split(F.col("_text"), "\n", -1)).alias("block", "_line"))
    own = blocks.withColumn("_set", F.array_distinct(words(F.col("_line"))))
    hits = own.select(*keys, "block", F.size("_set").cast("long").alias("n"), F.array_intersect("_set", strings(vocabulary)).alias("hits"))
    return hits.where(F.size("hits") > 0)


def rivals(sets: list[list[str]], threshold: float) -> list[list[list[str]]]:
    """For each template's words those of the others that share enough of them to meet it alone."""
    return [[r for j, r in enumerate(sets) if j != k and len(set(own) & set(r)) >= math.ceil(round(threshold * len(own), 9))] for k, own in enumerate(sets)]


def outdone(held: Column, share: Column, others: Column, near: Column) -> Column:
    """Whether all words held are words of one of the others, of which `near` holds a larger share."""
    return F.exists(others, lambda r: (F.size(F.array_except(held, r)) == 0) & (F.size(F.array_intersect(r, near)) / F.size(r) > share))


def join_templates(hits: DataFrame, keys: list[str], templates: list[tuple[str, str]], threshold: float, seen: dict[str, int]) -> DataFrame:
    """(keys, block, template, label, containment) of every block and template that meet the threshold; `seen` orders the words."""
    spark = hits.sparkSession
    sets = [sorted(set(t.split())) for t, _ in templates]
    vocabulary = sorted({w for s in sets for w in s})
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index, whole = [], []
    for k, (own, (_, label)) in enumerate(zip(sets, templates, strict=True)):
        need = needed(" ".join(own), threshold)
        ranked = sorted(own, key=order.get)
        whole.append((k, label, need, ranked))
        index += [(w, k, i, len(own), need) for i, w in enumerate(ranked[: len(own) - need + 1])]
    prefixes = spark.createDataFrame(index, "word string, template int, at int, size int, need int")
    whole = [(*x, y) for x, y in zip(whole, rivals(sets, threshold), strict=True)]
    whole_sets = spark.createDataFrame(whole, "template int, label string, _need int, words array<string>, rivals array<array<string>>")
    least = min(x[2] for x in whole)
    rank = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)])
    ranked = hits.where(F.size("hits") >= least).withColumn("hits", F.transform(F.array_sort(F.transform("hits", lambda w: F.struct(rank[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    start = F.slice("hits", F.lit(1), F.size("hits") - least + 1)
    tokens = ranked.select(*keys, "block", "n", "hits", F.posexplode(start).alias("spot", "word"))
    left_in_template, left_in_block = F.col("size") - F.col("at"), F.size("hits") - F.col("spot")
    near = tokens.join(F.broadcast(prefixes), "word").where((F.col("n") >= F.col("need")) & (F.col("spot") <= F.size("hits") - F.col("need")) & (F.least(left_in_template, left_in_block) + F.least("at", "spot") >= F.col("need")))
    near = near.dropDuplicates([*keys, "block", "template"])
    shared = F.size(F.array_intersect("hits", "words"))
    exact = near.join(F.broadcast(whole_sets), "template").withColumn("_shared", shared).where(F.col("_shared") >= F.col("_need"))
    held = F.array_intersect("hits", "words")
    exact = exact.where(~outdone(held, F.col("_shared") / F.size("words"), F.col("rivals"), F.col("hits")))
    return exact.select(*keys, "block", "template", "label", (F.col("_shared") / F.size("words")).alias("containment"))


def wrapped(found: DataFrame, keys: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(keys, label, containment) of every template that a window of words meets, in texts of several lines.

    A window has as many words as the template and begins at one of its words. Only texts that hold enough of a
    template's words anywhere are searched for it; a rival outdoes it by words up to a longest template away.
    """
    sets = [sorted(set(t.split())) for t, _ in templates]
    reach = max(len(t.split()) for t, _ in templates)
    rows = [(label, own, needed(t, threshold), len(t.split()), r) for (t, label), own, r in zip(templates, sets, rivals(sets, threshold), strict=True)]
    kind = "label string, words array<string>, need int, length int, rivals array<array<string>>"
    every = F.array(*[
        F.struct(F.lit(a).alias("label"), F.array(*map(F.lit, b)).alias("words"), F.lit(c).alias("need"), F.lit(d).alias("length"), F.array(*[F.array(*map(F.lit, x)) for x in e]).cast("array<array<string>>").alias("rivals"))
        for a, b, c, d, e in rows
    ]).cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in kind.split(', '))}>>")
    own = found.where(F.contains(F.col("_text"), F.lit("\n"))).select(*keys, "held", words(F.col("_text")).alias("_w"))
    own = own.select(*keys, "_w", F.explode(F.filter(every, lambda t: F.size(F.array_intersect(t["words"], F.col("held"))) >= t["need"])).alias("_t"))
    spots = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.array_contains(F.col("_t.words"), F.get("_w", i)))
    window = F.transform(spots, lambda i: F.struct(
        F.array_intersect(F.col("_t.words"), F.slice("_w", i + 1, F.col("_t.length"))).alias("held"),
        F.slice("_w", F.greatest(i + 1 - reach, F.lit(1)), F.col("_t.length") + 2 * reach).alias("near"),
    ))
    share = lambda x: F.size(x["held"]) / F.size("_t.words")
    met = F.filter(window, lambda x: (F.size(x["held"]) >= F.col("_t.need")) & ~outdone(x["held"], share(x), F.col("_t.rivals"), x["near"]))
    return own.select(*keys, F.col("_t.label").alias("label"), F.array_max(F.transform(met, share)).alias("containment")).where("containment is not null")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """A row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = templates or TEMPLATES
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    keys = ["_id", "_hash", "_bytes"]
    every = store.write(survey(docs, id_col, text_col, templates, threshold), "survey")
    seen = {r["word"]: r["n"] for r in every.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each vocabulary word
    found = every.where(F.col("_text").isNotNull())
    met = join_templates(block_hits(found, keys, vocabulary), keys, templates, threshold, seen)
    met = met.select(*keys, "label", "containment").unionByName(wrapped(found, keys, templates, threshold))
    met = met.groupBy(*keys).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    own = F.when(F.col("_text").isNotNull(), words(F.col("_text")))
    starts = [F.when(F.size(F.array_intersect("held", strings(p.split()))) == len(set(p.split())), phrase_starts(F.col("_words"), p)) for p, _ in PHRASES]
    base = every.withColumn("_words", own).withColumns({f"_p{k}": F.coalesce(s, F.array().cast("array<int>")) for k, s in enumerate(starts)})
    base = base.withColumn("_starts", F.concat(*[F.col(f"_p{k}") for k in range(len(PHRASES))]))
    base = base.select(
        *keys, "n_words", F.size("_starts").cast("long").alias("n_base"), F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])).alias("_labels"),
    )
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._hash") == F.col("b._hash")) & (F.col("a._bytes") == F.col("b._bytes"))
    both = base.alias("a").join(met.alias("b"), same, "left")
    labels = F.array_sort(F.array_distinct(F.concat("_labels", F.coalesce("_more", F.array().cast("array<string>")))))
    return both.select(
        F.col("a._id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("_labels")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
