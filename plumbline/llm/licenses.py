"""License scan by diagonal voting, with DataFrame functions only.

Rolling hashes of all word k-grams of a text are joined to the places where templates have them. A
shared k-gram votes for the diagonal (place in the text minus place in the template); neighbouring
diagonals, apart by a few inserted or missing words, are merged. The join compares the words too,
so a hash never decides alone. The hash keys are tested while the text is still whole, so only
k-grams that a template may have become rows; the same scan finds the phrases.

A merged span is verified word by word: each vote brings the words around its k-gram, and a word of the template counts if a
vote of the span holds it or has it within ``REACH`` places, shifted by one at most. A span holds if ``LEAST_SHARE`` of the template's words
count, so a replaced or an inserted word is forgiven in every template, and if the template's distinguishing words count, which tell
close licenses apart, and if the span isn't much longer than the template.

The templates are a parameter and are broadcast: their number is that of known licenses.
Besides, fixed phrases label every text that has them.

Defined cases: a null text counts as empty. Rows that agree in id and text get the same result.
Texts shorter than a k-gram have only phrase labels. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, staged

GRAM_WORDS = 3
SHIFT = 3
LEAST_SHARE = 0.8
REACH = 3
LONGEST = 1.5
# Phrases that label a text by themselves (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Usual notices of public licenses (fixed values): label, text, and the words that tell it from a close license.
TEMPLATES = (
    ("mit", "this project is released under the terms of the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "granted"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation", "gnu"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "authors"),
    ("boost", "distributed under the boost software license version 1 0", "boost"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "nd"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", "noderivatives"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license additional terms may apply", "sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("artistic", "you can redistribute it and or modify it under the terms of the artistic license", "artistic"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil"),
    ("psf", "this software is licensed under the python software foundation license version 2", "python"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "this work has been placed in the public domain by its author", "placed"),
)


def license_words(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case. (Lower case of the Kelvin sign is the only letter that would
    become ASCII by itself, so it is put aside.)"""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ᴷ")))
    spaced = F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(k)])


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively."""
    parts = phrase.split(" ")
    fits = lambda i: [F.get(words, i + j) == p for j, p in enumerate(parts)]

    def all_fit(i: Column) -> Column:
        found = fits(i)[0]
        for more in fits(i)[1:]:
            found = found & more
        return found
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), all_fit)).otherwise(none)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM_WORDS) -> DataFrame:
    """template, label, words, needed (places of the distinguishing words), hash, gram, template_pos."""
    rows = spark.createDataFrame([(i, label, text, needs) for i, (label, text, needs) in enumerate(templates)],
                                 "template int, label string, text string, needs string")
    words = rows.select("template", "label", license_words(F.col("text")).alias("words"), F.split("needs", " ").alias("needs")).where(F.size("words") >= k)
    needed = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda j: F.array_contains("needs", F.get("words", j)))
    placed = words.select("template", "label", "words", needed.alias("needed"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("template_pos"))
    return placed.select("template", "label", "words", "needed", "template_pos", _hash(F.col("words"), F.col("template_pos"), k).alias("hash"),
                         _gram(F.col("words"), F.col("template_pos"), k).alias("gram"))


def _hits(words: Column, keys: list[int], k: int) -> Column:
    """The k-grams that a template may have, each with the words around it."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - k), lambda i: _hash(words, i, k).isin(keys))
    edge = REACH + 1
    around = lambda i: F.transform(F.sequence(i - edge, i + (k - 1 + edge)), lambda j: F.when(j >= 0, F.get(words, j)))
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.struct(
        i.alias("pos"), _hash(words, i, k).alias("hash"), _gram(words, i, k).alias("gram"), around(i).alias("around")))).otherwise(
        F.array().cast("array<struct<pos:int,hash:bigint,gram:string,around:array<string>>>"))


def _counted(k: int) -> Column:
    """The places of the template whose words a vote holds: those of the k-gram, and those near it that the text has there or one place on."""
    # Place j of the template stands at j - template_pos + edge of the words around.
    offset = F.col("template_pos") - (REACH + 1)
    near = F.filter(F.sequence(F.greatest(F.col("template_pos") - REACH, F.lit(0)), F.least(F.col("template_pos") + (k - 1 + REACH), F.size("words") - 1)), lambda j: (
        j.between(F.col("template_pos"), F.col("template_pos") + (k - 1))
        | F.array_contains(F.slice("around", j - offset, F.lit(3)), F.get("words", j))))
    return near


def _spans_of(hits: DataFrame, grams: DataFrame, k: int, shift: int, least_share: float, longest: float) -> DataFrame:
    found = hits.select("id", "text_hash", F.explode("hits").alias("hit")).select("id", "text_hash", "hit.pos", "hit.hash", "hit.gram", "hit.around")
    votes = (found.join(F.broadcast(grams), ["hash", "gram"]).withColumn("counted", _counted(k))
             .groupBy("id", "text_hash", "template", "label", F.size("words").alias("size"), "needed", (F.col("pos") - F.col("template_pos")).alias("diagonal"))
             .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_distinct(F.flatten(F.collect_set("counted"))).alias("seen")))
    order = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    parted = votes.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > shift, F.lit(False)).cast("int"))
    merged = parted.withColumn("cluster", F.sum("apart").over(order)).groupBy("id", "text_hash", "template", "label", "size", "needed", "cluster").agg(
        F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    share = F.size("seen") / F.col("size")
    held = (share >= least_share) & (F.size(F.array_except("needed", "seen")) == 0) & (F.col("last") - F.col("first") + 1 <= F.col("size") * F.lit(longest))
    return merged.where(held).select("id", "text_hash", "label", "template", "first", "last", share.alias("share"))


def _grams_and_keys(docs: DataFrame, templates, k: int) -> tuple[DataFrame, list[int]]:
    grams = template_grams(docs.sparkSession, templates, k)
    return grams, [r.hash for r in grams.select("hash").distinct().collect()]  # bounded by the templates


def spans(docs: DataFrame, templates=TEMPLATES, id_column: str = "doc_id", text_column: str = "text", k: int = GRAM_WORDS,
          shift: int = SHIFT, least_share: float = LEAST_SHARE, longest: float = LONGEST) -> DataFrame:
    """Verified spans: id, text_hash, label, template, first, last (words of the text) and share of the template's words."""
    grams, keys = _grams_and_keys(docs, templates, k)
    hits = docs.select(docs[id_column].alias("id"), F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("text_hash"),
                       let(license_words(docs[text_column]), lambda words: _hits(words, keys, k)).alias("hits"))
    return _spans_of(hits, grams, k, shift, least_share, longest)


def scanned(docs: DataFrame, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    def base(words: Column) -> Column:
        # Each phrase ends in a word that few texts have; the others are done without a look at every word.
        places = [F.when(F.array_contains(words, p.split(" ")[-1]) & F.array_contains(words, p.split(" ")[0]), _places(words, p))
                  .otherwise(F.array().cast("array<int>")) for p in phrases]
        return F.struct(F.size(words).cast("long").alias("n"), F.array(*places).alias("places"), _hits(words, keys, GRAM_WORDS).alias("hits"))
    grams, keys = _grams_and_keys(docs, templates, GRAM_WORDS)
    # One scan of the texts gives phrases and k-grams; what it found is written, the texts aren't.
    texts = staged(docs.select(docs[id_column].alias("id"), F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("text_hash"),
                               let(license_words(docs[text_column]), base).alias("b")), "places")
    names = F.array(*[F.lit(x) for x in phrases.values()])
    labelled = F.array_sort(F.array_distinct(F.filter(F.transform("b.places", lambda x, i: F.when(F.size(x) > 0, F.get(names, i))),
                                                      lambda x: x.isNotNull())))
    every = F.flatten("b.places")
    info = texts.select("id", "text_hash", F.col("b.n").alias("n_words"), F.size(every).cast("long").alias("n_base"),
                        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                        labelled.alias("base"))
    hits = texts.where(F.size("b.hits") > 0).select("id", "text_hash", F.col("b.hits").alias("hits")).distinct()
    learnt = _spans_of(hits, grams, GRAM_WORDS, SHIFT, LEAST_SHARE, LONGEST).groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"))
    learnt = staged(learnt, "spans")
    both = info.join(learnt, info["id"].eqNullSafe(learnt["i"]) & (info["text_hash"] == learnt["h"]), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
