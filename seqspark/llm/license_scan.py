"""Licence scan with a positional rare-token index; DataFrame functions only.

Base places are those where a phrase's words stand consecutively. The index has, for each rare word
of the licence templates, its (template, position) postings and its document frequency over all
documents. Every file looks up its licence words. For each template that enough of them belong to,
the TOP ones of highest inverse document frequency count: their postings are intersected by relative
position (place in the file minus place in the template), and where at least SUPPORT of them agree on
one relative position and the template's key phrase is in the file, the file has the label. So each
of several licences in a file is found by its own words, and a key phrase alone finds nothing.

Defined results for odd rows: a null text is empty; without places n_base is 0, first_word and
last_word are null and the labels are empty strings; repeated rows are scanned as rows of their
own; other columns are ignored; an empty table gives an empty table. Letters beyond ASCII are
never folded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import cut

TOP, SUPPORT = 8, 0.6

#: Words of the base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Licence notices and statements (label, key phrase, text); several may share a label.
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license", "this program is licensed under the gnu affero general public license version 3"),
    ("agpl-3.0", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution license"),
    ("cc-by-4.0", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("cc0", "public domain dedication", "creative commons cc0 1 0 universal public domain dedication"),
    ("cc0", "public domain dedication", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty you should have received a copy of the cc0 public domain dedication along with this software"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2.0", "either version 2 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "either version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "must not be misrepresented", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
]
#: Words too frequent to be rare in any collection; not indexed.
FREQUENT = "a and any are as at by for in is it may of or org that the this to use with without you can be".split()

#: A word's letters, in either case, and what parts words.
LETTER, BREAK = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _pattern(phrases) -> str:
    """Java pattern of the places of any of the phrases, ASCII letters in either case."""
    either = "|".join((BREAK + "+").join(p.split()) for p in phrases)
    return f"(?i)(?<!{LETTER})(?:{either})(?!{LETTER})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER + "+")).cast("long")


def _all_of(words: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) == len(wanted)


def looked_up(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_words and hits, the distinct words of the file that are indexed or in a phrase."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Unicode lower-casing differs from that of A-Z only for letters that no indexed word has.
    rows = rows.withColumn("words", F.split(F.lower("text"), BREAK + "+"))
    # Only the first and the last word can be empty; the one word of an empty text is both.
    edges = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when(F.element_at("words", -1) == "", 1).otherwise(0)
    wanted = F.array(*map(F.lit, sorted({*vocabulary(), *(w for p in PHRASES for w in p.split())})))
    return rows.select("doc_id", "text", F.greatest(F.lit(0), F.size("words") - edges).cast("long").alias("n_words"), F.array_intersect("words", wanted).alias("hits"))


def base_columns(rows: DataFrame) -> DataFrame:
    """rows of looked_up() with n_base, first_word, last_word, base_labels (array)."""
    any_phrase = _pattern(PHRASES)
    # Places are only looked for where all words of a phrase occur.
    maybe = F.lit(False)
    for phrase in PHRASES:
        maybe = maybe | _all_of(F.col("hits"), phrase.split())
    rows = rows.withColumn("n_base", F.when(maybe, F.regexp_count("text", F.lit(any_phrase))).otherwise(0).cast("long"))
    has = F.col("n_base") > 0
    before_first = F.expr(f"substring(text, 1, regexp_instr(text, r'{any_phrase}') - 1)")
    before_last = F.regexp_extract("text", f"(?s)^(.*){any_phrase}", 1)
    # One array per phrase in order of labels; nothing is looked for where there is no place.
    labels = F.array(*(F.when(has & F.col("text").rlike(_pattern([p])), label) for p, label in sorted(PHRASES.items(), key=lambda x: x[1])))
    return rows.select(
        "*",
        F.when(has, n_words(before_first)).alias("first_word"),
        F.when(has, n_words(before_last)).alias("last_word"),
        F.filter(labels, lambda x: x.isNotNull()).alias("base_labels"),
    )


def folded(text: Column) -> Column:
    """The words of text, A-Z lowered, joined by single blanks."""
    spaced = F.trim(F.regexp_replace(text, BREAK + "+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()} - set(FREQUENT))


def indexed(text: str) -> list[tuple[str, int]]:
    """(word, place) of a template's indexed words."""
    return [(w, i) for i, w in enumerate(text.split()) if w not in FREQUENT]


def least(text: str) -> int:
    """How many of a template's words must agree: SUPPORT of TOP, or of all its distinct ones."""
    return math.ceil(SUPPORT * min(TOP, len({w for w, _ in indexed(text)})))


def worth_a_look(hits: Column) -> Column:
    """Whether the file has as many indexed words of some template as must agree."""
    found = F.lit(False)
    for text in sorted({text for _, _, text in TEMPLATES}):
        own = F.array(*map(F.lit, sorted({w for w, _ in indexed(text)})))
        found = found | (F.size(F.array_intersect(hits, own)) >= least(text))
    return (F.size(hits) >= min(least(text) for _, _, text in TEMPLATES)) & found


def template_postings(spark) -> DataFrame:
    """(word, template, at, label, rare): rare counts the template's indexed words."""
    rows = []
    for k, (label, _, text) in enumerate(TEMPLATES):
        rows += [(w, k, i, label, len({w for w, _ in indexed(text)})) for w, i in indexed(text)]
    return spark.createDataFrame(rows, "word string, template int, at int, label string, rare int")


def matches(rows: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """rows(row, text) as (row, label, coverage): verified labels and their best coverage.

    frequencies has the document frequency of each indexed word: (word, df)."""
    spark = rows.sparkSession
    rows = rows.withColumn("words", folded(F.col("text")))
    places = rows.select("row", F.posexplode(F.split("words", " ")).alias("place", "word"))
    idf = frequencies.select("word", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # Both tables broadcast have a bound: a row per indexed word, and one per word of a template.
    places = places.join(F.broadcast(idf), "word").join(F.broadcast(template_postings(spark)), "word")
    best = Window.partitionBy("row", "template").orderBy(F.desc("idf"), "word")
    hits = places.withColumn("n", F.dense_rank().over(best)).where(F.col("n") <= TOP)
    # A file's words at one relative position; a template cannot score more words than count.
    aligned = hits.groupBy("row", "template", "label", "rare", (F.col("place") - F.col("at")).alias("shift")).agg(F.count_distinct("word").alias("n"))
    coverage = F.least(F.lit(1.0), F.col("n") / F.least(F.col("rare"), F.lit(TOP)))
    aligned = aligned.groupBy("row", "template", "label").agg(F.max(coverage).alias("coverage")).where(F.col("coverage") >= SUPPORT)
    verified = F.lit(False)
    for key in dict.fromkeys(key for _, key, _ in TEMPLATES):
        own = [k for k, (_, other, _) in enumerate(TEMPLATES) if other == key]
        verified = verified | (F.col("template").isin(own) & F.concat(F.lit(" "), F.col("words"), F.lit(" ")).contains(f" {key} "))
    return aligned.join(rows.select("row", "words"), "row").where(verified).groupBy("row", "label").agg(F.max("coverage").alias("coverage"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    score is the best coverage of a verified template, and at least 0.5 where a base place exists."""
    # Written once, so that row numbers hold; only texts whose words may match are kept.
    base = base_columns(looked_up(docs)).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits", F.when(worth_a_look(F.col("hits")), F.col("text")).alias("text")
    )
    base = cut(base, "licences")
    frequencies = cut(base.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    found = matches(base.where("text IS NOT NULL").select("row", "text"), frequencies, base.count())
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    joined = base.drop("text", "hits").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"),
    )
