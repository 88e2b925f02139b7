"""Operator 2, license scans by diagonal voting.

All rolling word k-gram hashes of every document are joined to the positions
of the same grams in a small table of license templates.  A run of hits with
the same offset (text position minus template position) is a diagonal; hits
are counted per diagonal, neighbouring diagonals of one template are merged
into spans (they differ where words were put in or left out), and a span is
accepted when its hits cover enough of the template.  A hash alone makes no
hit: all words of the gram are compared with the template's, so what a span
covers stands in the text word for word.

Two gram sizes are in use: 2 for short phrases, where a full diagonal is a
place at which the phrase stands word for word, and 4 for longer passages.
The template table is a constant of the code (a few hundred grams) and is
broadcast for that reason; documents are read once, and only hits shuffle.

Only DataFrame functions run here.

Defined cases: null text is empty; a document without words has no places,
empty labels and score 0; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The phrases that the contract names, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Well-known sentences of public license texts, and their labels.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this work is licensed under the creative commons attribution sharealike": "cc-by-sa",
}

PHRASE_GRAM, PASSAGE_GRAM = 2, 4
#: Stands for the gram of a document's word count: no gram of words has these characters.
_COUNT_ROW = "#"


def words_of(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters, digits and all non-ASCII characters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text, F.lit(""))
    # lower() equals the A-Z mapping on pure ASCII and is much faster there
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, gram_text, template, label, base, offset, n_grams): a few hundred constant rows."""
    rows = []
    for templates, size, base in ((PHRASES, PHRASE_GRAM, True), (PASSAGES, PASSAGE_GRAM, False)):
        for template, label in templates.items():
            words = template.split()
            n = len(words) - size + 1
            rows += [(" ".join(words[i : i + size]), template, label, base, i, n) for i in range(n)]
    # the row that carries a document's word count through the join
    rows.append((_COUNT_ROW, "", None, False, 0, 0))
    table = spark.createDataFrame(rows, "gram_text string, template string, label string, base boolean, offset int, n_grams int")
    return table.withColumn("gram", F.xxhash64("gram_text"))


def gram_hits(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Hits of all rolling grams of all documents on the template table, one word-count row a document included."""

    def rolling(words: Column, size: int) -> Column:
        # beyond the last word there is null, which is left out: such grams are too short for any template
        texts = F.transform(words, lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, size)]))
        return F.transform(texts, lambda gram, i: F.struct(F.xxhash64(gram).alias("gram"), i.alias("at"), gram.alias("text")))

    tokens = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[f"`{doc_id}`"].alias("doc_id"), words_of(docs[f"`{text}`"]).alias("words")
    )
    own = F.array(F.struct(F.xxhash64(F.lit(_COUNT_ROW)).alias("gram"), F.size("words").alias("at"), F.lit(_COUNT_ROW).alias("text")))
    grams = tokens.select("row", "doc_id", F.explode(F.concat(own, rolling(F.col("words"), PHRASE_GRAM), rolling(F.col("words"), PASSAGE_GRAM))).alias("g"))
    flat = grams.select("row", "doc_id", "g.gram", "g.at", "g.text")
    return flat.join(F.broadcast(template_grams(docs.sparkSession)), "gram").filter("text = gram_text").drop("text", "gram_text")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_cover: float = 0.8, max_shift: int = 3) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    ``max_shift``: offsets that differ by at most this many words count as
    neighbouring diagonals.  ``min_cover``: share of a passage's grams that an
    accepted span has.  The score is the best cover of any template.
    """
    hits = gram_hits(docs, doc_id, text).withColumn("diagonal", F.col("at") - F.col("offset"))
    diagonals = hits.groupBy("row", "doc_id", "template", "label", "base", "n_grams", "diagonal").agg(
        F.count("*").cast("int").alias("votes"), F.collect_list("offset").alias("offsets"), F.min("at").alias("start"), F.max("at").alias("stop")
    )
    along = W.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > max_shift, F.lit(True))
    spans = (
        diagonals.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("row", "doc_id", "template", "label", "base", "n_grams", "span")
        .agg(F.min("diagonal").alias("diagonal"), F.size(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("covered"), F.min("start").alias("start"))
    )
    is_count = F.col("template") == ""
    cover = F.when(is_count, F.lit(0.0)).otherwise(F.col("covered") / F.col("n_grams"))
    spans = spans.withColumn("cover", cover)
    full = F.col("base") & (F.col("covered") == F.col("n_grams"))
    accepted = full | (~F.col("base") & ~is_count & (F.col("cover") >= min_cover))

    def joined(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return (
        spans.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(is_count, F.col("start"))).cast("long").alias("n_words"),
            F.count_if(full).alias("n_base"),
            F.min(F.when(full, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(full, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(full).alias("base_labels"),
            joined(accepted).alias("labels"),
            F.max("cover").alias("score"),
            F.count_if(accepted).alias("n_spans"),
        )
        .drop("row")
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE: dict[str, str] = {}
