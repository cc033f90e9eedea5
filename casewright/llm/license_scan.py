"""Licence texts by diagonal voting.

A template and a document that share a passage share its word pairs in the same
order, so (place in document - place in template) is the same for all of them:
a diagonal. The scan

1. joins the hashes of all rolling word pairs of every document to the pairs of
   the templates (a table of a few hundred fixed rows, hence broadcast) and
   checks both words of a hit;
2. counts hits by document, template and diagonal;
3. merges neighbouring diagonals, which a few inserted or missing words cause;
4. verifies the merged span by the share of the template's pairs it holds.

A short phrase is found at a place when all its pairs hit one diagonal. Hits are
dealt once, by document; all later steps stay within that distribution, and a
document has at most as many rows as it has words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.llm.rows import numbered

# Phrases whose places are counted, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public licence notices and names that give further labels.
NOTICES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("bsd 3 clause license", "bsd"),
    ("bsd 2 clause license", "bsd"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at", "apache",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied", "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation", "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met", "bsd",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

# Pairs made of these words alone say nothing about a licence and do not vote for a notice.
COMMON = set("a an and any are as at be by for from in is it of on or that the this to was with you".split())

WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
KELVIN = "K"  # lower-cases to an ASCII k, though it is no letter of a licence

# Diagonals this close, with spans at most this many words apart, belong to one passage.
NEIGHBOUR, APART = 3, 12
# Share of a notice's voting pairs that its span has to hold.
SHARE = 0.6


def template_pairs(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """(template, label, base, pairs, at, first, second, bit): the word pairs of all templates that vote."""
    rows = []
    for base, group in ((True, phrases or PHRASES), (False, notices or NOTICES)):
        for text, label in group:
            words = text.split()
            votes = [i for i in range(len(words) - 1) if base or not {words[i], words[i + 1]} <= COMMON]
            if not 1 <= len(votes) <= 62:
                raise ValueError(f"a template needs 1 to 62 voting pairs: {text}")
            number = len({r[0] for r in rows})
            rows += [(number, label, base, len(votes), i, words[i], words[i + 1], 1 << bit) for bit, i in enumerate(votes)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, at int, first string, second string, bit long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None, share: float = SHARE) -> DataFrame:
    """One row per document: counts and places of the phrases, labels, and the places of verified notices.

    ``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans)``; spans lists (label, first word, last word, share) of all that was
    found. Words are runs of letters and digits with A-Z in lower case and every
    character beyond ASCII taken as a letter. A null or empty text has no words,
    no labels and a score of 0; repeated rows and rows with a null id each give a
    row; other columns are not read; an empty table gives no rows. The score is
    the largest share of a template found: 1 where a phrase stands.
    """
    spark = docs.sparkSession
    pairs = template_pairs(spark, phrases, notices)
    keyed = F.broadcast(pairs.withColumn("h", F.xxhash64("first", "second")))  # as many rows as the templates have pairs
    lean = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    lowered = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(KELVIN), F.lit("ķ")))
    words = lean.select("row", "id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(1)).alias("words"))
    grams = F.transform(
        "words", lambda w, i: F.struct(i.alias("p"), F.xxhash64(w, F.get("words", i + 1)).alias("h"), w.alias("a"), F.get("words", i + 1).alias("b"))
    )
    # One more entry for each document, which no pair matches: documents without hits stay.
    own = F.array(F.struct((-1 - F.size("words")).alias("p"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    rolled = words.select("row", "id", F.explode(F.concat(own, grams)).alias("g")).select("row", "id", "g.*")
    hits = rolled.join(keyed, "h", "left").where("p < 0 OR (a = first AND b = second)")
    dealt = hits.select("row", "id", "p", "template", "label", "base", "pairs", "at", "bit").repartition("row")

    found = dealt.groupBy("row", "template", "label", "base", "pairs", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.first("id").alias("id"), F.min("p").alias("low"), F.max("p").alias("high"), F.bit_or("bit").alias("bits")
    )
    whole = F.col("base") & (F.bit_count("bits") == F.col("pairs"))
    by_place = Window.partitionBy("row", "template").orderBy("diagonal")
    joined = (F.col("diagonal") - F.lag("diagonal").over(by_place) <= NEIGHBOUR) & (F.col("low") - F.lag("high").over(by_place) <= APART)
    chained = found.withColumn("whole", whole).withColumn("start", F.when(joined & ~F.col("base"), 0).otherwise(1))
    chained = chained.withColumn("passage", F.sum("start").over(by_place))
    passages = chained.groupBy("row", "template", "label", "base", "pairs", "passage").agg(
        F.first("id").alias("id"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("bits").alias("bits"),
        F.bool_or("whole").alias("whole"),
    )
    held = F.bit_count("bits") / F.col("pairs")
    verified = F.when(F.col("base"), F.col("whole")).otherwise(held >= share)
    judged = passages.withColumn("held", held).withColumn("ok", F.col("template").isNotNull() & verified)
    is_base = F.col("ok") & F.col("base")
    span = F.struct("label", F.col("low").alias("first"), (F.col("high") + 1).alias("last"), F.col("held").alias("share"))
    return judged.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.max(F.when(F.col("template").isNull(), -1 - F.col("low"))).cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("held"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("spans"),
    ).drop("row")


@query()
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return scan(table(spark, folder, "documents")).drop("spans")
