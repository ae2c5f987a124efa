"""License scans by diagonal voting: word k-grams of the texts meet template positions and vote for offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.llm.common import checkpoint, let

LICENSE_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place counts, and templates of public licenses and notices, with their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
    ),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "this work has been dedicated to the public domain under cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def _template_grams(spark: SparkSession, k: int, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(h, template, at) for every rolling k-gram of phrases and templates, besides the row that every text meets."""
    texts = [text for _, text in (*PHRASES, *templates)]
    rows = [(i, at, " ".join(t.split()[at : at + k])) for i, t in enumerate(texts) for at in range(len(t.split()) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, at int, gram string").select(
        F.xxhash64(F.split("gram", " ")).alias("h"), "template", "at"
    )
    return grams.unionByName(spark.createDataFrame([(-1, -1, 0)], "template int, at int, h long"))


def scan_licenses(
    docs: DataFrame,
    *,
    text: str = "text",
    k: int = 2,
    gap: int = 2,
    min_share: float = 0.7,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> tuple[DataFrame, DataFrame]:
    """Find license phrases and texts: (documents, spans), with a row of documents for each row of ``docs``.

    Words are runs of letters a-z, digits and non-ASCII characters, in lower case.  All rolling ``k``-grams of the texts
    join the templates' k-grams, a table of fixed size; a match votes for the diagonal (place in the text minus place in
    the template).  Neighbouring diagonals of a row and template are merged: from each diagonal on, those that follow it
    by ``gap`` at most from one to the next, and by the share of the template that may be missing in all, so that words
    put in or left out do not cut a match, and a span is never longer than its template and that share.  A merged span is
    verified by the share of the template's k-grams that it holds, each counted once: ``min_share`` for templates, all,
    on one diagonal, for phrases.  A template's span goes where one that overlaps it has a greater share, or the same
    template's has the same and begins earlier, so that of notices that differ in a few words the closest is reported.

    documents has doc_id, n_words, n_base (places of phrases), first_word, last_word (least and greatest of them),
    base_labels, labels (comma-joined, sorted) and score (the greatest share verified, 1 for a phrase, 0 for nothing).
    spans has row (a number of the row, the same for no other), doc_id, label, is_phrase, start, end (words, the end
    exclusive) and share.

    Rows are told apart by a number of their own, so equal rows and rows with equal or null ids each have their result.
    The votes are checkpointed with it.  A null or empty text has no words.  Empty input gives empty output; other
    columns are ignored.
    """
    spark = docs.sparkSession
    sizes = [len(t.split()) for _, t in (*PHRASES, *templates)]
    labels = [label for label, _ in (*PHRASES, *templates)]
    n_phrases = len(PHRASES)
    drifts = [0] * n_phrases + [math.ceil((1 - min_share) * n) for n in sizes[n_phrases:]]
    of = lambda values, template: F.element_at(F.lit(list(values)), F.greatest(F.lit(1), template + 1))
    w = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), LICENSE_GAP), "")
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", w.alias("w"))
    none = F.array().cast("array<bigint>")
    rolled = F.when(
        F.size("w") >= k,
        let(F.col("w"), lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (k - 1)), lambda i: F.xxhash64(F.slice(v, i, F.lit(k))))),
    ).otherwise(none)
    # The first entry meets the template -1, so that texts without a match stay.
    grams = d.select("row", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), rolled)).alias("p", "h"))
    met = grams.join(F.broadcast(_template_grams(spark, k, templates)), "h")
    # Written before any shuffle: the numbers of the rows are then fixed, whatever is computed again.
    met = checkpoint(met.select("row", F.when(F.col("template") < 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("template") < 0, F.col("n")).alias("n"), "template", (F.col("p") - 1 - F.col("at")).alias("diagonal"), "at"))
    rows = met.where("template < 0").select("row", "doc_id", F.col("n").cast("long").alias("n_words"))

    votes = met.where("template >= 0").groupBy("row", "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    here = F.struct("diagonal", "ats")
    following = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, max(drifts))

    def reached(seen: Column) -> Column:
        """The diagonals that are reached from the first by steps of ``gap`` and within the template's drift."""
        step = lambda acc, x: F.when(x["diagonal"] - F.element_at(acc, -1)["diagonal"] <= gap, F.concat(acc, F.array(x))).otherwise(acc)
        near = F.filter(seen, lambda x: x["diagonal"] - seen[0]["diagonal"] <= of(drifts, F.col("template")))
        return F.aggregate(F.slice(near, 2, F.greatest(F.lit(0), F.size(near) - 1)), F.slice(near, 1, 1), step)

    merged = votes.withColumn("seen", F.array_sort(F.collect_list(here).over(following))).withColumn("seen", let(F.col("seen"), reached))
    held = F.size(F.array_distinct(F.flatten(F.col("seen.ats"))))
    spans = merged.select(
        "row",
        "template",
        F.array_min(F.transform("seen", lambda x: x["diagonal"] + F.array_min(x["ats"]))).alias("start"),
        F.array_max(F.transform("seen", lambda x: x["diagonal"] + F.array_max(x["ats"]) + k)).alias("end"),
        (held / (of(sizes, F.col("template")) - (k - 1))).alias("share"),
        (F.col("template") < n_phrases).alias("is_phrase"),
    )
    spans = spans.where(F.when(F.col("is_phrase"), F.col("share") == 1).otherwise(F.col("share") >= min_share))
    longest = max(sizes) + max(drifts)
    around = W.partitionBy("row", "is_phrase").orderBy("start").rangeBetween(-longest, longest)
    me = F.struct("start", "end", "share", "template")
    overlaps = lambda o: (o["start"] < F.col("end")) & (o["end"] > F.col("start"))
    earlier = lambda o: (o["start"] < F.col("start")) | ((o["start"] == F.col("start")) & (o["end"] < F.col("end")))
    closer = lambda o: (o["share"] > F.col("share")) | ((o["share"] == F.col("share")) & (o["template"] == F.col("template")) & earlier(o))
    spans = spans.withColumn("others", F.collect_list(me).over(around))
    spans = spans.where(F.col("is_phrase") | ~F.exists("others", lambda o: overlaps(o) & closer(o)))
    spans = spans.select("row", of(labels, F.col("template")).alias("label"), "is_phrase", "start", "end", "share")

    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    documents = (
        rows.join(spans, "row", "left")
        .groupBy("row")
        .agg(
            F.first("doc_id", True).alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(F.col("is_phrase"), 1)).alias("n_base"),
            F.min(F.when(F.col("is_phrase"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("is_phrase"), F.col("start"))).cast("long").alias("last_word"),
            join(F.when(F.col("is_phrase"), F.col("label"))).alias("base_labels"),
            join(F.col("label")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
    return documents, spans.join(rows.drop("n_words"), "row").select("row", "doc_id", "label", "is_phrase", "start", "end", "share")


def op4_license_scans(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)[0]
