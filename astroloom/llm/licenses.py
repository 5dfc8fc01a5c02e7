"""Licence detection with a positional rare-token index, in DataFrame functions only.

Template texts are posted as (word, template, offset). The corpus's document frequencies of template words give their
IDF. For each template, the rarest of its words that a file has are looked up; a place of one in the file and its offset
in the template fix a relative position, at which the other postings are intersected with the file's words, so words of
one notice line up and strays do not. A template that enough of the looked-up postings line up for is a label if its
mandatory key phrases stand in the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """label, text, and phrases that must all stand in a file for the label."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Notices as projects print them.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("mit-notice", "Released under the MIT License", ("mit license",)),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words of a template that are looked up in a file, the rarest first of those that the file has, and the share of them
#: that must line up. Each template has its own, so notices in one file do not crowd each other out.
LOOKED_UP = 12
LINED_UP = 0.7
#: What stands between two words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Lower-cased words of a text. ``lower`` also folds letters beyond A-Z, which neither moves a word's bounds nor
    makes or unmakes a word of the phrases: no other letter folds to one that they hold, alone."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def phrase_starts(words: Column, phrase: str, hint: Column) -> Column:
    """Word numbers (from 0) where the phrase's words stand consecutively; looked for only where ``hint`` holds."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    places = F.sequence(F.lit(0), F.size(words) - len(parts))
    return F.when(hint & (F.size(words) >= len(parts)), F.filter(places, stands)).otherwise(F.array().cast("array<int>"))


def template_frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, df, idf for every template word, over all documents (a word that none holds has df 0)."""
    held = docs.select(F.explode(F.array_intersect(words_of("text"), F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    every = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    # Both sides have at most a row per template word.
    return every.join(held, "word", "left").crossJoin(F.broadcast(total)).select(
        "word", F.coalesce("df", F.lit(0)).alias("df"), F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)).alias("idf")
    )


def _tuple(word: str, label: str, offset: int) -> Column:
    return F.struct(F.lit(word).alias("word"), F.lit(label).alias("label"), F.lit(offset).alias("offset"))


def best_share(words: Column, places: Column, mine: Column) -> Column:
    """The largest share of the looked-up postings ``mine`` (rarest first) that stand at one relative position.

    If a share of LINED_UP of n postings line up, one of the n - ceil(LINED_UP n) + 1 rarest does, so only the places of
    these give relative positions to try; at each, the file's words are read where the postings put them."""
    n = F.size(mine)
    first = F.slice(mine, 1, F.greatest(n - F.ceil(n * LINED_UP).cast("int") + 1, F.lit(1)))
    tried = F.flatten(F.transform(first, lambda p: F.transform(F.filter(places, lambda x: x["word"] == p["word"]), lambda x: x["at"] - p["offset"])))
    stand = lambda rel: F.size(F.filter(mine, lambda p: F.get(words, rel + p["offset"]) == p["word"]))
    return F.when(n > 0, F.array_max(F.transform(F.array_distinct(tried), stand)) / n)


def licence_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """The rows' doc_id with n_words, n_base, first_word, last_word, base_labels, labels and score (the best lined-up
    share of a label, 1 for a base phrase, else 0). One row per row.

    Nulls and empty texts have no words, no labels and score 0. Each row is judged on its own, so equal ids, copies and
    hot sources change nothing; only doc_id and text are read. No text is shuffled."""
    docs = docs.select("doc_id", "text")
    tokens = {t.label: _tokens(t.text) for t in templates}
    vocabulary = sorted({w for of in tokens.values() for w in of})
    # The template library's size bounds what is fetched here: a number for each of its words.
    idf = {r.word: float(r.idf) for r in template_frequencies(docs, vocabulary).collect()}
    known = F.array(*map(F.lit, vocabulary))
    # No label stands in a file that holds none of the phrases, whatever is around their words.
    phrase = "|".join(sorted({GAP.join(p.split()) for p in [*(p for p, _ in phrases), *(p for t in templates for p in t.mandatory[:1])]}))
    text = F.lower(F.coalesce("text", F.lit("")))
    hint = text.rlike(phrase) if all(t.mandatory for t in templates) else F.lit(True)
    rows = docs.select("doc_id", words_of("text").alias("words"), hint.alias("hint"))

    starts = [phrase_starts(F.col("words"), p, F.col("hint")).alias(f"at_{k}") for k, (p, _) in enumerate(phrases)]
    rows = rows.select("doc_id", "words", "hint", *starts, F.when(F.col("hint"), F.array_intersect("words", known)).alias("has"))
    # The postings of each template that are looked up: the rarest of the words that the file has.
    looked = []
    for t in templates:
        posted = F.array(*[_tuple(w, t.label, k) for k, w in sorted(enumerate(tokens[t.label]), key=lambda x: (-idf[x[1]], x[1], x[0]))])
        looked.append(F.slice(F.filter(posted, lambda p: F.array_contains("has", p["word"])), 1, LOOKED_UP))
    rows = rows.withColumn("looked", F.when(F.col("hint"), F.array(*looked)))
    wanted = F.array_distinct(F.transform(F.flatten("looked"), lambda p: p["word"]))
    rows = rows.withColumn("wanted", F.when(F.col("hint"), wanted))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("wanted", x["word"]))
    rows = rows.withColumn("places", F.when(F.col("hint"), places))
    rows = rows.withColumn("joined", F.when(F.col("hint"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    shares = []
    for i, t in enumerate(templates):
        stand = F.col("hint")
        for p in t.mandatory:
            stand = stand & F.contains("joined", F.lit(f" {p} "))
        share = best_share(F.col("words"), F.col("places"), F.get("looked", F.lit(i)))
        shares.append(F.when(stand, F.struct(F.lit(t.label).alias("label"), share.alias("share"))))
    rows = rows.withColumn("found", F.when(F.col("hint"), F.filter(F.array_compact(F.array(*shares)), lambda x: x["share"] >= LINED_UP)))
    every = F.concat(*[f"at_{k}" for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    found = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, found))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_labels(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


QUERIES = {"op3_licenses": op3_licenses}
ORACLE_SQL: dict[str, str] = {}
