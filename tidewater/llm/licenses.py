"""License scan by a positional rare-token index, in DataFrame functions only.

Licence words are ranked by inverse document frequency over all files. The index has each template's ``top_words`` rarest words:
word -> (template, position). Of each file the words that the index has are looked up, and
the postings vote for a (template, place in the file) pair by relative position. A template whose votes cover
enough of its indexed words at one place is accepted once its mandatory key phrase is there too; files without the last word of any
key phrase can have none, so only the others send their words.

Null, empty and wordless texts, and files without licence words, have no label and score 0. Rows that repeat an id are read by their
own texts; texts of any length are read whole; of equally rare words the first by name is taken.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import ascii_lower, let, saved

#: Phrases of the base scan and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, template text, mandatory key phrase. Short notices, and the texts that licences ask to be put into files.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge",
    ),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "without warranty of any kind"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "www apache org licenses",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation",
    ),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATOR), lambda w: w != "")


def _places(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another (0-based)."""
    parts = phrase.split()
    n = F.size(w)
    hit = lambda i: F.get(w, i) == parts[0]
    for k, p in enumerate(parts[1:], 1):
        hit = (lambda prev, k, p: lambda i: prev(i) & F.coalesce(F.get(w, i + k) == p, F.lit(False)))(hit, k, p)
    return F.filter(F.when(n >= len(parts), F.sequence(F.lit(0), n - len(parts))).otherwise(F.array().cast("array<int>")), hit)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_words: int = 8, coverage: float = 0.6) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the share of an accepted template's indexed words that its best place matches (1 for a base label).
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    lowered = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rh"), words(F.col(text_col)).alias("w"))
    cues = sorted({k.split()[-1] for _, _, k in TEMPLATES} | {"license"})
    base = saved(
        lowered.select(
            "id",
            "rh",
            F.size("w").cast("long").alias("n_words"),
            F.array_intersect("w", F.array(*map(F.lit, vocabulary))).alias("seen"),
            F.when(F.arrays_overlap("w", F.array(*map(F.lit, cues))), F.col("w")).alias("cw"),
        ).select(
            "id",
            "rh",
            "n_words",
            "seen",
            *[F.when(F.col("cw").isNotNull(), let(F.col("cw"), partial(_places, phrase=p))).alias(f"b{k}") for k, p in enumerate(BASE_PHRASES)],
            F.filter(F.transform(F.col("cw"), lambda x, i: F.struct(i.alias("p"), x.alias("x"))), lambda s: s["x"].isin(vocabulary)).alias("licence_words"),
        )
    )
    # Document frequency of each licence word, over all files: at most as many rows as the vocabulary.
    total = base.count()
    seen = base.select(F.explode("seen").alias("x")).groupBy("x").count().collect()
    df = {r["x"]: r["count"] for r in seen}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary}
    rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    # Each template is indexed by its rarest words.
    postings = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        parts = text.split()
        for p in sorted(range(len(parts)), key=lambda p: (rank[parts[p]], p))[:top_words]:
            postings.append((parts[p], t, p))
    index = spark.createDataFrame(postings, T.StructType([T.StructField("x", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("tp", T.IntegerType())]))
    indexed = {t: sum(1 for q in postings if q[1] == t) for t in range(len(TEMPLATES))}
    chosen = F.filter("licence_words", lambda s: s["x"].isin(sorted({q[0] for q in postings})))
    hits = base.where(F.size("licence_words") > 0).select("id", "rh", F.explode(chosen).alias("s")).select("id", "rh", F.col("s.p").alias("p"), F.col("s.x").alias("x"))
    votes = hits.join(F.broadcast(index), "x").groupBy("id", "rh", "t", (F.col("p") - F.col("tp")).alias("at")).agg(F.count_distinct("tp").alias("v"))
    need = F.create_map(*[F.lit(v) for kv in indexed.items() for v in kv])
    placed = votes.withColumn("cover", F.col("v") / need[F.col("t")]).where(F.col("cover") >= coverage)
    # Mandatory phrases: all of the phrase's words at the place that the alignment gives them.
    required = []
    for t, (_, text, phrase) in enumerate(TEMPLATES):
        parts, key = text.split(), phrase.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        required += [(t, at + k, w) for k, w in enumerate(key)]
    wanted = spark.createDataFrame(required, "t int, tp int, x string")
    sizes = F.create_map(*[F.lit(v) for t, (_, _, p) in enumerate(TEMPLATES) for v in (t, len(p.split()))])
    all_hits = base.where(F.size("licence_words") > 0).select("id", "rh", F.explode("licence_words").alias("s")).select("id", "rh", F.col("s.p").alias("p"), F.col("s.x").alias("x"))
    verified = (
        placed.join(F.broadcast(wanted), "t")
        .withColumn("p", F.col("at") + F.col("tp"))
        .join(all_hits, ["id", "rh", "p", "x"])
        .groupBy("id", "rh", "t", "at", "cover")
        .agg(F.count_distinct("tp").alias("k"))
        .where(F.col("k") >= sizes[F.col("t")])
    )
    label = F.create_map(*[F.lit(v) for t, (name, _, _) in enumerate(TEMPLATES) for v in (t, name)])
    found = verified.groupBy("id", "rh").agg(F.collect_set(label[F.col("t")]).alias("more"), F.max("cover").alias("cover"))
    none = F.array().cast("array<int>")
    spots = [F.coalesce(F.col(f"b{k}"), none) for k in range(len(BASE_PHRASES))]
    every = F.concat(*spots)
    named = F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(n)) for s, n in zip(spots, BASE_PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    out = base.join(found, ["id", "rh"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size(named) > 0, 1.0).otherwise(F.coalesce(F.col("cover").cast("double"), F.lit(0.0))).alias("score"),
    )
