"""License scans by a positional rare-token index (operator 6), with DataFrame functions only.

Templates are licence texts and short notices, indexed as postings (word, template,
place). A first pass counts the documents that hold each word of any template; the
words of highest IDF of each template, half of them and at least LEAST, are indexed.
Of each text, the indexed words of every template are looked up, however many
templates it holds; the places of a template's words that keep their distance from
the template's beginning vote for (template, beginning). A template with enough
votes gives its label if the text also holds all its mandatory phrases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# Licence texts and notices in words, and the phrases each needs.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("except in compliance with the license", "governing permissions and limitations")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd", "bsd license", ("bsd license",)),
    ("bsd", "bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd", "bsd 3 clause license", ("bsd 3 clause",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("redistribute it and or modify it", "either version 3 of the license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("deal in the software without restriction", "substantial portions of the software")),
    ("mit", "mit license", ("mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone", "redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words of a template that are indexed at least; it has all, if it has fewer.
LEAST = 4
#: Share of a template's looked-up words that must agree on its beginning.
AGREE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SEPARATORS)


def rarest(words: list[str], held: dict[str, int], total: int) -> list[str]:
    """The words with the highest IDF, by the number of documents that hold each of all total: half of them and at least LEAST; ties by the word."""
    idf = {w: math.log((1 + total) / (1 + held.get(w, 0))) for w in words}
    return sorted(idf, key=lambda w: (-idf[w], w))[: max(LEAST, -(-len(idf) // 2))]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text; further columns are ignored).

    Null and empty texts have no words, no labels (empty strings) and score 0. score
    is 1 where a base phrase stands, else the best share of a labelled template's
    looked-up words that agree. Texts that hold fewer than two looked-up words and not
    the rarest word of a base phrase have no template's label. Repeated rows come back as often as they came; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()} | {w for p, _ in base for w in p.split()})
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])

    words = docs.select(F.array_intersect(_words(F.coalesce("text", F.lit(""))), literal([*vocabulary, ""])).alias("w"))
    counts = words.select(F.explode(F.array_append("w", F.lit(None).cast("string"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # at most a row a word of the templates; null counts documents
    held = {r["word"]: r["n"] for r in counts}
    total = held.get(None, 0)
    indexed = [set(rarest(t.split(), held, total)) for _, t, _ in templates]
    rare = sorted(set().union(*indexed))
    anchors = sorted({min(p.split(), key=lambda w: (held.get(w, 0), w)) for p, _ in base})

    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.coalesce("text", F.lit(""))).alias("w"))
    size = F.size("w")
    lead, trail = (F.get("w", F.lit(0)) == "").cast("int"), ((F.element_at("w", -1) == "") & (size > 1)).cast("int")
    found = split.select("doc_id", "w", lead.alias("lead"), (size - lead - trail).cast("long").alias("n_words"), F.array_intersect("w", literal(rare)).alias("present"))
    candidate = (F.size("present") >= 2) | F.arrays_overlap("w", literal(anchors))
    hits = F.filter(F.transform("w", lambda w, i: F.struct((i - F.col("lead")).cast("long").alias("at"), w.alias("word"))), lambda x: x["word"].isin(*vocabulary))
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    holds = [F.when(F.lit(True) if not phrases else _all([F.col("joined").contains(f" {p} ") for p in phrases]), F.lit(k)) for k, (_, _, phrases) in enumerate(templates)]
    scanned = found.select("doc_id", "n_words", "present", F.when(candidate, hits).alias("hits"), F.when(candidate, joined).alias("joined"))
    scanned = scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "present", "hits", F.when(F.col("joined").isNotNull(), F.array_compact(F.array(*holds))).alias("holds"))
    scanned = keep(scanned, "scanned")

    # Base phrases: places of hits whose next hits are the phrase's next words at the next places.
    def stands(phrase: str):
        ws = phrase.split()

        def test(x: Column, i: Column) -> Column:
            ok = x["word"] == ws[0]
            for k, w in enumerate(ws[1:], 1):
                y = F.get(F.col("hits"), i + k)
                ok = ok & F.coalesce((y["word"] == w) & (y["at"] == x["at"] + k), F.lit(False))
            return ok

        return F.transform(F.filter("hits", test), lambda x: x["at"])

    marked = scanned.where("hits is not null")
    marked = marked.select("row", "present", "hits", "holds", *[stands(p).alias(f"p{k}") for k, (p, _) in enumerate(base)])
    places = F.concat(*[F.col(f"p{k}") for k in range(len(base))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    based = marked.select("row", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("own"))

    postings = F.broadcast(spark.createDataFrame([(w, k, at) for k, (_, t, _) in enumerate(templates) for at, w in enumerate(t.split()) if w in indexed[k]], "word string, template int, place long"))
    asked = marked.select("row", F.explode("present").alias("word")).join(postings.select("word", "template").distinct(), "word").groupBy("row", "template").agg(F.count("*").alias("asked"))
    where = marked.select("row", F.explode("hits").alias("hit")).select("row", "hit.word", "hit.at")
    votes = where.join(postings, "word").groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("row", "template").agg(F.max("votes").alias("votes")).join(asked, ["row", "template"])
    best = best.withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("asked"))).where(F.col("share") >= AGREE)
    best = best.join(marked.select("row", F.explode("holds").alias("template")), ["row", "template"])
    labelled = F.element_at(literal([label for label, _, _ in templates]), F.col("template") + 1)
    added = best.withColumn("template", labelled).groupBy("row").agg(F.collect_set("template").alias("more"), F.max("share").alias("share"))

    out = scanned.select("row", "doc_id", "n_words").join(based, "row", "left").join(added, "row", "left")
    none = F.array().cast("array<string>")
    own, more = F.coalesce("own", none), F.coalesce("more", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, more))), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
