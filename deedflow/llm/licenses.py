"""License scans by diagonal voting, in Spark's own functions.

Every rolling hash of ``GRAM`` words of a text is looked up among the hashes of license templates (texts and notices of public
licenses).  A hit at word i of the text and word j of a template is verified word by word and votes for diagonal i - j.
Diagonals merge if they are at most ``SLACK`` apart (words put in or left out) and go on in the text and in the template where
the one before ended; so copies of a template in one text stay apart.  A merged span is a license if it holds enough of the
template's words at their places.  The templates are constants of at most 128 words, so the broadcast side has a fixed size.

Words are exploded inside one generated stage with the lookup, so no row is written for a position without a hit.  A
position -1 stands for the document itself and keeps documents without hits.

Defined cases: null text counts as empty; a row of the input gives a row of the output even if doc_id repeats or is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .native import inline, word_array

GRAM = 3
SLACK = 2
#: Hits of neighbouring diagonals are one span if the next begins at most so many words behind the last.
GAP = 8
#: Of a template's words, the share that a merged span must hold in their order; templates of at most SHORT words must be whole.
LEAST_WORDS = 0.7
SHORT = 8

# The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Texts of public licenses and their notices, as words, that the method adds.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "bsl-1"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("under the bsd license", "bsd"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4", "cc-by"),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template: its words, place j, and the template's length."""
    rows = [(i, phrase, label, i < len(BASE)) for i, (phrase, label) in enumerate(BASE + TEMPLATES)]
    grams = (
        inline(spark, ["tid", "phrase", "label", "is_base"], rows)
        .withColumn("words_t", F.split("phrase", " "))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.size("words_t") - GRAM)))
        .withColumn("gram_words", F.slice("words_t", F.col("j") + 1, F.lit(GRAM)))
        .select(gram_hash("words_t", F.col("j")).alias("gram"), "tid", "j", "label", "is_base", "gram_words", F.size("words_t").alias("size_t"))
    )
    none = {"tid": F.lit(-1), "j": F.lit(0), "label": F.lit(None).cast("string"), "is_base": F.lit(False), "gram_words": F.lit(None).cast("array<string>"), "size_t": F.lit(0)}
    return grams.unionByName(spark.range(1).select(F.xxhash64(F.lit("document")).alias("gram"), *[c.alias(n) for n, c in none.items()]))


def gram_hash(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(GRAM)])


def places_held(half: int) -> Column:
    """Bits of the template's places that a hit holds, of places 0 to 63 or 64 to 127."""
    bits = [F.when(F.floor((F.col("j") + i) / 64) == half, F.expr(f"shiftleft(1L, (j + {i}) % 64)")).otherwise(F.lit(0).cast("long")) for i in range(GRAM)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of base phrases, labels and a score."""
    grams = template_grams(docs.sparkSession)
    positions = (
        docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("rid"), word_array(F.col("text")).alias("words"))
        .select("doc_id", "rid", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - GRAM, F.lit(-1)))).alias("i"))
        .withColumn("gram", F.when(F.col("i") < 0, F.xxhash64(F.lit("document"))).otherwise(gram_hash("words", F.col("i"))))
    )
    template = ["rid", "doc_id", "tid", "label", "is_base"]
    hits = (
        positions.join(F.broadcast(grams), "gram")
        .filter(((F.col("tid") < 0) & (F.col("i") < 0)) | ((F.col("i") >= 0) & (F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.lit(GRAM)) == F.col("gram_words"))))
        .select(*template, "i", "j", (F.col("i") - F.col("j")).alias("diag"), F.size("words").cast("long").alias("n_words"), "size_t")
        .repartition(F.col("rid"))
    )
    # votes: the hits of a template on one diagonal, each at another place of the template
    diagonals = hits.groupBy(*template, "diag").agg(
        F.max("n_words").alias("n_words"), F.max("size_t").alias("size_t"), F.count("*").alias("votes"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("j").alias("first_j"), F.max("j").alias("last_j"),
        F.bit_or(places_held(0)).alias("low"), F.bit_or(places_held(1)).alias("high"),
    )
    along = Window.partitionBy("rid", "tid").orderBy("first_i", "diag")
    before = lambda c: F.lag(c).over(along)
    goes_on = (F.abs(F.col("diag") - before("diag")) <= SLACK) & (F.col("first_i") - before("last_i") <= GRAM + GAP) & (F.col("first_j") > before("last_j"))
    whole = F.col("is_base") & (F.col("votes") == F.col("size_t") - GRAM + 1)
    spans = (
        diagonals.withColumn("apart", F.when(goes_on, 0).otherwise(1))
        .withColumn("span_no", F.sum("apart").over(along))
        .withColumn("base_at", F.when(whole, F.col("diag")))
        .groupBy(*template, "span_no")
        .agg(
            F.max("n_words").alias("n_words"), F.count("base_at").alias("n_base"), F.min("base_at").alias("first_word"), F.max("base_at").alias("last_word"), F.max("size_t").alias("size_t"),
            (F.bit_count(F.bit_or("low")) + F.bit_count(F.bit_or("high"))).alias("n_held"),
        )
        .withColumn("share", F.coalesce(F.try_divide("n_held", "size_t"), F.lit(0.0)))
        .withColumn("found", F.when(F.col("is_base"), F.col("n_base") > 0).otherwise((F.col("tid") >= 0) & (F.col("share") >= F.when(F.col("size_t") <= SHORT, 1.0).otherwise(LEAST_WORDS))))
    )
    label = lambda wanted: F.concat_ws(",", F.array_sort(F.collect_set(F.when(wanted, F.col("label")))))
    return (
        spans.groupBy("rid", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"), F.sum("n_base").alias("n_base"),
            F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
            label(F.col("is_base") & F.col("found")).alias("base_labels"), label(F.col("found")).alias("labels"),
            F.max(F.when(F.col("found"), F.col("share")).otherwise(0.0)).alias("score"),
        )
        .drop("rid")
    )
