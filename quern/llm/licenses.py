"""License scans by diagonal voting, in DataFrame operations only.

Every three words in a row of a document are joined to the places where license texts have them.
Such a match votes for a diagonal: the document's place less the license text's. Votes are counted for
each document, license text and diagonal; neighbouring diagonals, which inserted or missing words
cause, are merged; and a merged span is accepted by the share of the license text's words that it has in their places.
The words of a match are compared themselves with those of the license text, so no hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words in a row that vote.
GRAM = 3
#: Diagonals so far apart are neighbours.
NEIGHBOUR = 4
#: Share of a license text's grams that a merged span has at least, and the likeness from which it is accepted.
VOTES, LIKENESS = 0.3, 0.7

# Phrases that name a license, and license texts and notices in common use, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEXTS = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: stretches of ASCII letters and digits and of all characters beyond ASCII, A to Z in lower case; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def _grams(words: str) -> Column:
    """place, and the words w1 to w3, of every GRAM words in a row."""
    shifted = [F.col(words) if n == 0 else F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))) for n in range(GRAM)]
    whole = F.size(words) - (GRAM - 1)
    zipped = F.arrays_zip(*[F.slice(x, 1, F.greatest(whole, F.lit(0))).alias(f"w{n + 1}") for n, x in enumerate(shifted)])
    return F.posexplode(zipped)


def _gram_rows(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """A row for each gram: the keys, its place, its hash and its words."""
    made = rows.select(*keys, _grams("words").alias(place, "gram"))
    return made.select(*keys, place, F.xxhash64("gram.w1", "gram.w2", "gram.w3").alias("hash"), *[F.col(f"gram.w{n + 1}").alias(f"{place}_w{n + 1}") for n in range(GRAM)])


def license_texts(rows: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """text_no, label, size and words of each license text."""
    session = rows.sparkSession
    listed = F.array(*[F.struct(F.lit(n).alias("text_no"), F.lit(label).alias("label"), F.lit(text).alias("text")) for n, (label, text) in enumerate(texts)])
    made = session.range(1).select(F.inline(listed)).withColumn("words", words_of(F.col("text")))
    return made.select("text_no", "label", F.size("words").alias("size"), "words")


def license_spans(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, likeness: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, label, text_no, first_word, last_word, likeness of each accepted span.

    likeness is twice the words that stand in their places over the words of both the license text and the
    span, from 0 to 1. digest is the text's hash, which tells rows with one id apart; equal rows are one.
    Null and empty texts have no span, null ids are kept. License texts of fewer than GRAM words are never found.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), words_of(F.col(text_col)).alias("words"))
    known = license_texts(docs, texts)
    probe = F.broadcast(_gram_rows(known.where(F.col("size") >= GRAM), ["text_no", "label", "size"], "at"))  # as many rows as the license texts have words
    # the words are compared behind the join, so that its key is the hash, one number
    same = F.forall(F.array(*[F.array(f"place_w{n + 1}", f"at_w{n + 1}") for n in range(GRAM)]), lambda x: x[0] == x[1])
    found = _gram_rows(rows, ["doc_id", "digest"], "place").join(probe, "hash").where(same)
    keys = ["doc_id", "digest", "text_no", "label", "size"]
    votes = found.groupBy(*keys, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))  # no more than the license text's places
    order = Window.partitionBy("doc_id", "digest", "text_no").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    # a repeated notice makes a long row of neighbours: it is cut where the diagonal has moved by the length of the text
    merged = votes.withColumn("session", F.sum(apart.cast("int")).over(order))
    start = F.min("diagonal").over(Window.partitionBy("doc_id", "digest", "text_no", "session"))
    merged = merged.withColumn("part", F.floor((F.col("diagonal") - start) / F.col("size")))
    span = merged.groupBy(*keys, "session", "part").agg(F.collect_list(F.struct("diagonal", "places")).alias("lines"))
    covered = F.flatten(F.transform("lines", lambda x: F.flatten(F.transform(x["places"], lambda p: F.array(*[p + n for n in range(GRAM)])))))
    placed = F.flatten(F.transform("lines", lambda x: F.flatten(F.transform(x["places"], lambda p: F.array(*[x["diagonal"] + p + n for n in range(GRAM)])))))
    grams = F.size(F.array_distinct(F.flatten("lines.places")))
    span = span.where(grams >= F.ceil(VOTES * (F.col("size") - (GRAM - 1)))).withColumns({"covered": F.size(F.array_distinct(covered)), "first_word": F.array_min(placed).cast("long"), "last_word": F.array_max(placed).cast("long")})
    wide = F.greatest(F.col("last_word") - F.col("first_word") + 1, F.col("covered"))
    scored = span.withColumn("likeness", F.least(2 * F.col("covered") / (F.col("size") + wide), F.lit(1.0)))
    return scored.where(F.col("likeness") >= likeness).select("doc_id", "digest", "label", "text_no", "first_word", "last_word", "likeness")


def _phrase_places(words: str, phrase: str, label: str) -> Column:
    """(place, label) of every place where a phrase's words stand."""
    first, *more = phrase.split(" ")
    places = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    for n, part in enumerate(more, 1):
        places = _followed(places, words, n, part)
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))


def _followed(places: Column, words: str, n: int, part: str) -> Column:
    return F.filter(places, lambda i: F.get(words, i + n).eqNullSafe(F.lit(part)))


def license_report(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    n_base counts the places of all phrases, first_word and last_word are the smallest and largest of their
    starts, null without any; base_labels are these phrases' labels, labels also those of the spans of
    license_spans(), each distinct, sorted and joined by commas, empty without any. score is 1 with a phrase, else
    the greatest likeness of a span, else 0. A null text counts as empty. Ids may be of any type,
    null or repeated: rows are told apart by their texts, too. An empty table gives an empty result; other columns are not read.
    """
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    named = F.lit(False)
    for phrase, _ in phrases:
        named = named | lowered.contains(phrase.split(" ")[-1])  # nothing to look for in other texts
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), named.alias("named"), words_of(F.col(text_col)).alias("words"))
    none = F.array().cast("array<struct<place:bigint,label:string>>")
    based = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.when(F.col("named"), F.concat(*[_phrase_places("words", *x) for x in phrases])).otherwise(none).alias("base"))
    spans = license_spans(docs, texts, id_col=id_col, text_col=text_col)
    more = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("digest").alias("span_digest")).agg(F.collect_set("label").alias("found"), F.max("likeness").alias("best"), F.count(F.lit(1)).alias("n_spans"))
    joined = based.join(more, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("digest") == F.col("span_digest")), "left")
    own = F.array_distinct(F.col("base.label"))
    every = F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.place")).alias("first_word"),
        F.array_max(F.col("base.place")).alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
