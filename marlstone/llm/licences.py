"""Licence scans: a positional index of the rarest licence words, templates placed by relative position, key phrases verified."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.session import write_cut

RARE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_SCORE = 0.5

# Phrases whose places are reported, with their labels (fixed values).
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Function words that are neither indexed nor scored (fixed values).
FUNCTION_WORDS = frozenset("a an and any are as at be for from in is it its may not of on or our that the this to under we with you your".split())


class Template(NamedTuple):
    """Words of a licence text or reference, and the phrases in it that must stand at their places."""

    label: str
    text: str
    keys: tuple[str, ...]


# Sentences of public licences and of usual references to them (fixed values).
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
             "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
             "merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby granted free", "software without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
             "as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met", ("binary forms", "permitted provided", "following conditions")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission", ("copyright holder nor", "without specific prior written permission")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
             "that the above copyright notice and this permission notice appear in all copies", ("without fee", "hereby granted provided")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released", "public domain")),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    Template("cc-by-4.0", "Creative Commons Attribution 4.0 International", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ("creative commons attribution noncommercial 4 0",)),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def postings(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, str, int, str, bool]]:
    """(template, label, place, word, in a key phrase) for every word of the templates that is no function word."""
    rows = []
    for t, template in enumerate(templates):
        words, key = words_of(template.text), set()
        for phrase in template.keys:
            own = words_of(phrase)
            at = next((i for i in range(len(words)) if words[i:i + len(own)] == own), None)
            if at is None or FUNCTION_WORDS.intersection(own):
                raise ValueError(f"{phrase!r} is no phrase of its template without function words")
            key.update(range(at, at + len(own)))
        rows += [(t, template.label, i, w, i in key) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
    return rows


def _hits(text: Column, vocabulary: list[str]) -> Column:
    """Struct of the number of words and the (pos, word) of those in the vocabulary; the words are handed on, so they are found once."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.filter(F.transform(ws, lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word"))), lambda h: h["word"].isin(vocabulary)).alias("hits")))[0]


def _places(hits: Column, phrases: dict[str, str]) -> Column:
    """(pos, label) wherever the words of a phrase stand consecutively; ``hits`` has every such word by position."""
    def found(phrase: str, label: str) -> Column:
        words = words_of(phrase)

        def starts(h: Column, i: Column) -> Column:
            following = [F.get(hits, i + j) for j in range(1, len(words))]
            here = h["word"] == words[0]
            for j, (other, word) in enumerate(zip(following, words[1:], strict=True), 1):
                here = here & F.coalesce((other["word"] == word) & (other["pos"] == h["pos"] + j), F.lit(False))
            return here

        return F.transform(F.filter(hits, starts), lambda h: F.struct(h["pos"].alias("pos"), F.lit(label).alias("label")))

    return F.concat(*[found(p, label) for p, label in phrases.items()])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
                  phrases: dict[str, str] | None = None, rare: int = RARE) -> DataFrame:
    """One row per row of ``docs``: doc, n_words, places (array of pos, label), found (array of label, pos, score).

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.  ``places`` are those where the
    words of one of ``phrases`` stand consecutively.  ``found`` comes from the templates: licence words are counted
    over all documents; the ``rare`` key words of a template with the highest inverse document frequency (ties by
    word) are its postings in the index.  A file's occurrences of such words are looked up, the postings give
    places of the template relative to the file, and those where all postings of a template agree go on.  There
    all its key phrases must stand, word for word; as a template needs every key word, looking up the rarest
    loses none.  ``score`` is the share of the template's words at their places, weighted by 1 + 1000 ln((N + 1) /
    (df + 1)) in whole numbers.

    Texts are read once, by built-in functions alone; what is kept of them are the positions of licence words other
    than function words.  The index has the size of the templates.  Null and empty texts have no words and nothing
    found; rows with one id, or none, are scanned one by one; an empty table has no rows.  Other columns of ``docs``
    are not used.
    """
    spark = docs.sparkSession
    phrases = BASE_PHRASES if phrases is None else phrases
    index = postings(templates)
    vocabulary = sorted({w for *_, w, _ in index} | {w for p in phrases for w in words_of(p)})
    hits = write_cut(docs.select(quoted(id_col).alias("doc"), _hits(quoted(text_col), vocabulary).alias("h"))
                     .select("doc", F.monotonically_increasing_id().alias("row"), "h.n_words", "h.hits"), "licence-words")

    # Weights of the vocabulary: as many rows as it has words.
    df = hits.select(F.explode_outer(F.array_distinct("hits.word")).alias("word")).groupBy("word").count()
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    weight = (F.lit(1) + F.round(1000 * F.log((F.col("total") + 1) / (F.coalesce("count", F.lit(0)) + 1)))).cast("long")
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, '{label}', {place}L, '{word}', {key})" for t, label, place, word, key in index)
                      + " AS t(template, label, place, word, key)")
    weighted = write_cut(table.join(df, "word", "left").withColumn("total", total.scalar())
                         .select("template", "label", "place", "word", "key", weight.alias("weight")), "licence-index")
    sizes = weighted.groupBy("template").agg(F.sum(F.col("key").cast("int")).alias("n_key"), F.sum("weight").alias("all_weight"))
    keys = weighted.where("key").groupBy("template", "word").agg(F.min("place").alias("place"), F.first("weight").alias("weight"))
    ranked = keys.groupBy("template").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("weight"), "word", "place"))), 1, rare).alias("top"))
    lookup = ranked.select("template", F.size("top").alias("wanted"), F.inline("top")).select("template", "wanted", "word", "place")

    # One occurrence of a rare word gives one place of the template, so the rows are in proportion to the hits.
    seen = hits.where(F.size("hits") > 0).select("row", F.inline("hits"))
    placed = (seen.join(F.broadcast(lookup), "word").groupBy("row", "template", (F.col("pos") - F.col("place")).alias("at"))
              .agg(F.count(F.lit(1)).alias("votes"), F.first("wanted").alias("wanted")).where("votes = wanted"))
    expected = placed.join(F.broadcast(weighted), "template").select("row", "template", "label", "at", (F.col("at") + F.col("place")).alias("pos"), "word", "key", "weight")
    found = (expected.join(seen, ["row", "pos", "word"]).groupBy("row", "template", "label", "at")
             .agg(F.sum(F.col("key").cast("int")).alias("keys"), F.sum("weight").alias("weight"))
             .join(F.broadcast(sizes), "template").where("keys = n_key")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", F.col("at").alias("pos"), (F.col("weight") / F.col("all_weight")).alias("score")))).alias("found")))
    nothing = F.array().cast("array<struct<label:string,pos:bigint,score:double>>")
    return hits.join(found, "row", "left").select(
        "doc", "n_words", F.sort_array(_places(F.col("hits"), phrases)).alias("places"), F.coalesce("found", nothing).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """``scanned`` as doc, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is that of the best template; a place of a phrase alone counts ``BASE_SCORE``, nothing found 0.
    """
    base, own = F.col("places.label"), F.col("found.label")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.select(
        "doc", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.pos").alias("first_word"), F.array_max("places.pos").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("found.score"), F.lit(0.0)), F.when(F.size("places") > 0, BASE_SCORE).otherwise(0.0)).alias("score"))
