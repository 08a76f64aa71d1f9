"""License scans by diagonal voting.

Words are maximal runs of ASCII letters and digits and of all characters
beyond ASCII, with A-Z lower-cased. The hash of every k-word gram of a
document is joined to the places where that gram stands in a license template;
a match votes for the diagonal (document place minus template place). Votes of
neighbouring diagonals, which a few inserted or dropped words leave apart, are
merged into a span, each diagonal with the one before it. A span counts if,
read from left to right, places of the template that come after all those
before them make up enough of it; this greedy reading may find less than the
longest run in order. The templates are a fixed list in this module, so their
side of the join is broadcast.

Defined results: a null text is the empty text; equal texts share their votes
and so their labels; rows with a null id are scanned as others are; very long
texts are scanned whole; an empty table gives an empty result; other columns of
the input, whatever their names, stay out of the computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import salted_left_join

#: Phrase and label of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and text of the templates that votes are cast for.
TEMPLATES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-line", "licensed under the mit license"),
    ("mit-line", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-line", "under the terms of the gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("lgpl-line", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-line", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache-2.0", "spdx license identifier apache 2 0"),
    ("spdx-gpl", "spdx license identifier gpl"),
    ("spdx-lgpl", "spdx license identifier lgpl"),
    ("spdx-agpl", "spdx license identifier agpl"),
    ("spdx-bsd", "spdx license identifier bsd"),
    ("spdx-mpl-2.0", "spdx license identifier mpl 2 0"),
)
K = 3
#: Diagonals at most this far apart merge into one span.
NEAR = 3
#: Share of a template's grams that a span has to cover.
LEAST = 0.8

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of ``text``. ``lower`` is the quick way, but it turns two
    letters beyond ASCII (U+212A and U+0130) into ASCII ones, so that texts that hold them
    go through ``translate``."""
    low = F.when(text.rlike("[\u212A\u0130]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


def grams(words: str, k: int = K) -> Column:
    """Hashes of all k-word grams of the array column ``words``, in order."""
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k}))) ELSE CAST(array() AS array<bigint>) END")


def template_grams(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, label, n_grams, at) for each place of each template."""
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, label, body.split(" ")) for i, (label, body) in enumerate(templates)], "template int, label string, words array<string>")
    return rows.select("template", "label", F.size(grams("words", k)).alias("n_grams"), F.posexplode(grams("words", k)).alias("at", "gram"))


def votes(texts: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(blob, template, label, n_grams, at, pos): every place of a template's gram in a text."""
    exploded = texts.select("blob", F.posexplode(grams("words", k)).alias("pos", "gram"))
    hits = exploded.join(F.broadcast(template_grams(texts, templates, k)), "gram")
    # copies of a text vote once
    return hits.groupBy("blob", "template", "pos", "at").agg(F.first("label").alias("label"), F.first("n_grams").alias("n_grams"))


def spans(hits: DataFrame, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """(blob, template, label, first, last, score) of the verified spans.

    Diagonals of a text and template that lie within ``near`` of the one before
    form one span. A template's place counts once in a span, and places that
    stand out of order are not counted: verification keeps a vote only if no
    vote kept before it in this span matched the same or a later template place.
    """
    diagonals = hits.groupBy("blob", "template", "label", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("pos", "at")).alias("places"))
    # a group is the votes of one text for one template: no more than the text's words times that template's places with one gram
    ordered = "PARTITION BY blob, template ORDER BY diagonal"
    marked = diagonals.withColumn("new", F.expr(f"CASE WHEN diagonal - lag(diagonal) OVER ({ordered}) <= {near} THEN 0 ELSE 1 END"))
    numbered = marked.withColumn("span", F.expr(f"sum(new) OVER ({ordered} ROWS UNBOUNDED PRECEDING)"))
    merged = numbered.groupBy("blob", "template", "label", "n_grams", "span").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    verified = F.expr(
        "aggregate(places, named_struct('at', -1, 'n', 0, 'first', -1, 'last', -1), (a, p) -> CASE WHEN p.at > a.at THEN named_struct("
        "'at', p.at, 'n', a.n + 1, 'first', CASE WHEN a.first < 0 THEN p.pos ELSE a.first END, 'last', p.pos) ELSE a END)"
    )
    return (
        merged.withColumn("v", verified)
        .select("blob", "template", "label", F.col("v.first").alias("first"), F.col("v.last").alias("last"), (F.col("v.n") / F.col("n_grams")).alias("score"))
        .filter(F.col("score") >= least)
    )


def phrase_starts(words: str) -> Column:
    """(place, label) of all places of the base phrases; every phrase ends in its rarest word, so most texts are left at once."""
    by_last: dict[str, list] = {}
    for phrase, label in PHRASES:
        *before, last = phrase.split(" ")
        by_last.setdefault(last, []).append((before, label))
    parts = []
    for last, ends in by_last.items():
        for before, label in ends:
            k = len(before)
            test = " AND ".join([f"get({words}, i) = '{last}'", *[f"get({words}, i - {k - j}) = '{w}'" for j, w in enumerate(before)]])
            parts.append(
                f"CASE WHEN array_contains({words}, '{last}') THEN transform(filter(sequence(0, size({words}) - 1), i -> {test}), "
                f"i -> named_struct('place', i - {k}, 'label', '{label}')) ELSE CAST(array() AS array<struct<place:int,label:string>>) END"
            )
    return F.expr(f"concat({', '.join(parts)})")


def scan(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", templates=TEMPLATES, k: int = K, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """Per document: n_words, places of base phrases, base_labels, labels with those of the templates, score.

    ``score`` is 1 where a base phrase stands, else the best share of a template that a verified span covers, else 0.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    keyed = docs.select(F.col(doc_id), F.sha2(text, 256).alias("blob"), words_of(text).alias("words"))
    found = (
        spans(votes(keyed, templates, k), near, least)
        .groupBy("blob")
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    )
    base = keyed.withColumn("places", phrase_starts("words")).select(
        doc_id, "blob",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").cast("long").alias("first_word"),
        F.array_max("places.place").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("places.label")).alias("_base"),
    )
    joined = salted_left_join(base, found, "blob", F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        doc_id, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
