"""License scan by diagonal voting, in DataFrame operations only.

A-Z is lower-cased, words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (digits, letters, everything beyond ASCII). Every rolling K-word hash of a
text is joined to the positions of that hash in the templates; a hit whose words are verified to be the template's votes for the
diagonal (text position - template position). Full votes of a short phrase on one diagonal are a place of it; for the longer notices, neighbouring diagonals
(words put in or left out) merge, and a merged span counts when it holds enough of the template and little else, or when one
diagonal in it has every vote of the template.

A null text is empty; a text without words has n_words 0, no labels and score 0. Every input row gives one output row, also
where ids repeat or are null; extra columns are not read. Texts of any length are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 3
#: Share of a template's hashes a span must hold, share of a span's hashes that must vote, and diagonals that merge.
LEAST_SHARE, LEAST_DENSITY, SLACK = 0.6, 0.5, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices found by voting, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
]


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def grams_of(words: Column) -> Column:
    """(pos, h) of all runs of K words: where each starts, and its hash."""
    n = F.size(words)
    at = F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(words, i + j) for j in range(K))).alias("h")))


def _with_words(grams: Column, words: Column) -> Column:
    return F.transform(grams, lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), F.slice(words, g["pos"] + 1, K).alias("run")))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(h, run, tpl, tpos, grams, base, label): a fixed table of a few hundred rows."""
    rows = [(i, t, label, i < len(phrases)) for i, (t, label) in enumerate([*phrases, *notices])]
    words = spark.createDataFrame(rows, "tpl int, t string, label string, base boolean").select("tpl", "label", "base", words_of(F.col("t")).alias("w"))
    grams = _with_words(grams_of(F.col("w")), F.col("w"))
    return words.select("tpl", "label", "base", F.size(grams).alias("grams"), F.inline(grams)).withColumnRenamed("pos", "tpos").withColumnRenamed("run", "trun")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = templates(docs.sparkSession)
    hashes = [r["h"] for r in known.select("h").distinct().collect()]  # of the fixed table
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    # runs that no template has end inside the row's array: only hits become rows, and one row for a text without any
    hits = F.filter(grams_of(F.col("w")), lambda g: g["h"].isin(hashes))
    grams = words.select("rid", "id", F.size("w").cast("long").alias("n_words"), F.inline_outer(_with_words(hits, F.col("w"))))
    met = grams.join(F.broadcast(known), (grams["h"] == known["h"]) & (F.col("run") == F.col("trun")), "left")
    votes = met.groupBy("rid", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
    )
    near = W.partitionBy("rid", "tpl").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True)) | F.col("base")
    cluster = F.sum(fresh.cast("int")).over(near.rowsBetween(W.unboundedPreceding, 0))
    spans = votes.withColumn("cluster", F.coalesce(cluster, F.lit(0))).groupBy("rid", "tpl", "cluster").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.max(F.col("votes") == F.col("grams")).alias("full"), F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    dense = F.col("votes") / (F.col("hi") - F.col("lo") + 1)
    place = F.col("base") & (F.col("votes") == F.col("grams"))
    found = place | (~F.col("base") & (F.col("full") | ((share >= LEAST_SHARE) & (dense >= LEAST_DENSITY))))
    joined = lambda ok: F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",")
    return spans.groupBy("rid").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("lo"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"), joined(found).alias("labels"), F.coalesce(F.max(F.when(found, share)), F.max(F.when(~F.col("base"), share * dense)), F.lit(0.0)).alias("score"),
    ).drop("rid")
