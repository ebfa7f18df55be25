"""Operator 4, licence scans: a positional rare-token index (native: DataFrame functions only).

Base: places where the words of a PHRASES phrase stand consecutively. Method: document frequencies of all template words
are counted over the corpus; each template is indexed by its POSTINGS rarest words with their positions. Of each
template's indexed words that a file has, the KEYS with the highest IDF are looked up, so other templates' words take no
template's place; each occurrence votes for a place of the template (occurrence minus posting), and the largest number of
different words that agree on a place is the template's vote. A template's label is given when at least NEED of its
looked-up words agree, three at least, and all of its mandatory phrases occur in the text.

The vocabulary is the templates' (fixed, a few hundred words), so its counts and the index are literals; a text is judged
in its own row, and nothing but those counts is shuffled. Repeated words cost time in proportion to their number.

Nulls: a null text is empty; ids may be null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import let

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, mandatory phrases, opening or notice words of the public licence.
TEMPLATES = (
    ("mit-text", ("permission is hereby granted", "without restriction"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2.0-notice", ("licensed under the apache license version 2 0",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-notice", ("free software", "gnu general public license"), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-text", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"),
    ("isc-text", ("permission to use copy modify and or distribute this software",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0-notice", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-notice", ("creative commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("unlicense-text", ("public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("lgpl-notice", ("gnu lesser general public license",), "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl-notice", ("gnu affero general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-3-clause", ("may be used to endorse or promote products",), "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("epl-2.0-notice", ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("zlib-text", ("alter it and redistribute it freely",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("cc-by-sa-notice", ("creative commons attribution sharealike 4 0",), "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
)
POSTINGS, KEYS, LEAST, NEED = 12, 8, 3, 0.6
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def folded(docs: DataFrame) -> DataFrame:
    """docs with _f: the words, single spaced, with a space before and after ('' if none); ASCII case is left."""
    cut = F.btrim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _GAPS, " "), F.lit(" "))
    return docs.withColumn("_f", F.when(cut == "", cut).otherwise(F.concat(F.lit(" "), cut, F.lit(" "))))


def _words() -> Column:
    return F.split(F.btrim(F.lower("_f"), F.lit(" ")), " ")


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def frequencies(texts: DataFrame) -> dict[str, int]:
    """Documents with each template word, over the whole corpus. texts: of folded."""
    vocabulary = sorted({w for *_, t in TEMPLATES for w in t.split()})
    counts = texts.select(F.explode(F.array_intersect(_words(), _strings(vocabulary))).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counts.collect()}


def index(df: dict[str, int], n: int) -> list[tuple[str, tuple[str, ...], list[str], list[tuple[str, int]]]]:
    """For each template its label, mandatory phrases, indexed words by falling IDF and postings."""
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in df.items()}
    out = []
    for label, phrases, text in TEMPLATES:
        words = text.split()
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:POSTINGS]
        out.append((label, phrases, rare, [(w, i) for i, w in enumerate(words) if w in rare]))
    return out


def _most_agreeing(pairs: Column) -> Column:
    """Largest number of pairs with one place; pairs are different (place, word) structs."""
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["at"].eqNullSafe(x["at"]), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x["at"].alias("at"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.sort_array(pairs), zero, step)["best"]


def _templates(f: Column, templates: list) -> Column:
    """array<struct<label, share>> of the templates whose words agree, or empty."""
    known = F.array(*(F.struct(F.lit(label).alias("label"), _strings(list(phrases)).alias("phrases"), _strings(rare).alias("rare"), F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("p")) for w, i in postings)).alias("postings")) for label, phrases, rare, postings in templates))
    indexed = sorted({w for *_, rare, _ in templates for w in rare})

    def with_keys(found: Column) -> Column:
        """The templates with at least LEAST keys: their KEYS rarest words that the file has."""

        def of(t: Column) -> Column:
            keys = F.slice(F.array_intersect(t["rare"], found), 1, KEYS)
            return let(keys, lambda own: F.struct(t["label"].alias("label"), t["phrases"].alias("phrases"), own.alias("keys"), F.filter(t["postings"], lambda q: F.array_contains(own, q["w"])).alias("postings")))

        return F.filter(F.transform(known, of), lambda t: F.size(t["keys"]) >= LEAST)

    def votes(occurrences: Column, some: Column, low: Column) -> Column:
        def of(t: Column) -> Column:
            own = F.size(t["keys"])
            places = F.array_distinct(F.flatten(F.transform(occurrences, lambda o: F.transform(F.filter(t["postings"], lambda q: q["w"] == o["w"]), lambda q: F.struct((o["i"] - q["p"]).alias("at"), o["w"].alias("w"))))))
            best = _most_agreeing(places)
            good = (best >= F.greatest(F.lit(LEAST), F.ceil(NEED * own).cast("int"))) & F.forall(t["phrases"], lambda p: F.contains(low, F.concat(F.lit(" "), p, F.lit(" "))))
            return F.struct(t["label"].alias("label"), F.when(good, best / F.greatest(own, F.lit(1))).otherwise(F.lit(0.0)).alias("share"))

        return F.filter(F.transform(some, of), lambda x: x["share"] > 0)

    def look(all_words: Column) -> Column:
        def with_templates(some: Column) -> Column:
            def with_words(top: Column) -> Column:
                occurrences = F.filter(F.transform(all_words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda o: F.array_contains(top, o["w"]))
                return let(occurrences, lambda o: let(F.lower(f), lambda low: votes(o, some, low)))

            return F.when(F.size(some) > 0, let(F.array_distinct(F.flatten(F.transform(some, lambda t: t["keys"]))), with_words))

        return let(F.array_intersect(_strings(indexed), all_words), lambda found: F.when(F.size(found) >= LEAST, let(with_keys(found), with_templates)))

    return F.coalesce(let(_words(), look), F.array().cast("array<struct<label:string,share:double>>"))


def licence_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = folded(docs.select("doc_id", "text"))
    templates = index(frequencies(texts), docs.count())
    f = F.col("_f")
    some = F.contains(F.lower(f), F.lit(" license "))
    n_words = F.greatest(_spaces(f) - 1, F.lit(0))
    df = texts.drop("text").withColumns({"n_words": n_words.cast("long"), "_some": some, "_found": _templates(f, templates)})
    for k, (phrase, _) in enumerate(PHRASES):
        parts = F.split(f, f"(?i) {re.escape(phrase).replace(chr(92) + ' ', ' ')}(?= )", -1)
        df = df.withColumn(f"_p{k}", F.when(F.col("_some"), parts).otherwise(F.array(f)))
    n = [F.size(f"_p{k}") - 1 for k in range(len(PHRASES))]
    first = [F.when(n[k] > 0, _spaces(F.element_at(f"_p{k}", 1))) for k in range(len(PHRASES))]
    last = [F.when(n[k] > 0, F.col("n_words") - (_spaces(F.element_at(f"_p{k}", -1)) - 1) - len(phrase.split())) for k, (phrase, _) in enumerate(PHRASES)]
    labels = F.array_compact(F.array(*(F.when(n[k] > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    shares = F.transform("_found", lambda x: x["share"])
    return df.select(
        "doc_id", "n_words", sum(n[1:], n[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.transform("_found", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(F.array_max(shares), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
