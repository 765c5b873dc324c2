"""License notices in texts, by votes on diagonals.

All rolling word 3-grams of all texts are joined with the 3-grams of the notice templates. Each hit
votes for a diagonal, the hit's place in the text less its place in the template. A template without
gaps puts all votes on one diagonal; words put in or left out move the rest to a neighbour, so
diagonals at most ``SLACK`` apart are merged. A merged span is verified by its words: those that decide
between a license and its neighbours, such as its version, have to stand there in full, and of the whole
template a share of ``COVER``. Joins compare the words themselves besides their hash.

Only DataFrame functions: texts are cut, exploded, joined with the templates (a fixed table of a few
hundred rows) and pre-aggregated inside the scanning stage; what is shuffled are votes. A vote's
places in the template are bits of one long, so that the aggregation keeps plain numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM, SLACK, COVER = 3, 2, 0.6
#: ASCII characters that part words: all but letters and digits.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels, as the contract has them.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wordings found by vote, at most 62 words each, so that places fit into a long. The words in brackets
#: decide between a license and its neighbours: all of them have to stand, in order, or it is not this one.
NOTICES = {
    "released under [the mit license]": "mit",
    "permission is hereby granted free of charge to [any person obtaining a copy] of this software": "mit",
    "licensed under the [apache license version 2] 0": "apache-2",
    "licensed under the [apache license version 2] 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under the [apache license version 1 1]": "apache-1-1",
    "licensed under [cc by nc] 4 0": "cc-by-nc",
    "licensed under [cc by sa] 4 0": "cc-by-sa",
    "licensed under [cc by nd] 4 0": "cc-by-nd",
    "[creative commons attribution noncommercial]": "cc-by-nc",
    "[creative commons attribution sharealike]": "cc-by-sa",
    "[creative commons attribution noderivatives]": "cc-by-nd",
    "[cc0 1 0 universal]": "cc0",
    "licensed under the [gnu general public license version 3]": "gpl-3",
    "licensed under the [gnu general public license version 2]": "gpl-2",
    "under the terms of the [gnu general public license] as published by the free software foundation either [version 3 of the] license": "gpl-3",
    "under the terms of the [gnu general public license] as published by the free software foundation either [version 2 of the] license": "gpl-2",
    "[gnu lesser general public license]": "lgpl",
    "[gnu affero general public license]": "agpl",
    "[mozilla public license version 2] 0": "mpl-2",
    "[mozilla public license version 1] 1": "mpl-1",
    "redistribution and use in [source and binary forms] with or without modification are permitted": "bsd",
    "permission to use copy modify and or [distribute this software for any purpose] with or without fee is hereby granted": "isc",
    "[boost software license version 1] 0": "boost",
    "[eclipse public license] v 2 0": "epl",
    "this is [free and unencumbered software] released into the public domain": "unlicense",
    "[all rights reserved]": "all-rights-reserved",
}


def parsed(text: str) -> tuple[list[str], int]:
    """The words of a template, and the places of those 3-grams, as bits, that lie inside brackets."""
    words, inside, deciding = text.replace("[", " [ ").replace("]", " ] ").split(), False, []
    said = []
    for word in words:
        if word in "[]":
            inside = word == "["
            # A run that ends parts what decides before it from what decides after it.
            deciding.append(None)
        else:
            said.append(word)
            deciding.append(inside)
    runs, at = [], 0
    for mark in deciding:
        if mark is None:
            runs.append([])
        else:
            if mark:
                runs[-1].append(at)
            at += 1
    return said, sum(1 << i for run in runs for i in run[: len(run) - GRAM + 1])


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """A row per 3-gram of each template: its words, its place, and the template's label, length and deciding places."""
    rows = []
    for number, (text, label) in enumerate([*base.items(), *notices.items()]):
        said, need = parsed(text)
        grams = len(said) - GRAM + 1
        if not 1 <= grams <= 60:
            raise ValueError(f"a template has 3 to 62 words: {text!r}")
        rows += [(*said[i : i + GRAM], number, i, grams, need, label, number < len(base)) for i in range(grams)]
    return spark.createDataFrame(rows, "t0 string, t1 string, t2 string, template int, place int, grams int, need long, label string, is_base boolean")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row for each row of ``docs``.

    A word is a run of letters and digits (every character outside ASCII counts as one), compared
    with A-Z lower-cased. Base phrases count at every place where their words stand consecutively.
    ``labels`` holds theirs and those of every wording of which at least ``COVER`` and all deciding
    words are there; ``score`` is the largest share covered of a wording whose deciding words stand, 1
    if a base phrase stands in full. Deciding words must be at least three in a row. A null text is empty: no words,
    no labels, score 0. Repeated rows come back as often as they came; other columns are ignored.
    """
    spark = docs.sparkSession
    # Lower-casing beyond A-Z changes neither a word's borders nor its being outside ASCII.
    said = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), PARTS), "")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), said.alias("w"))
    grams = texts.select(
        "row",
        "doc_id",
        F.size("w").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, 1 << 30).alias("w1"), F.slice("w", 3, 1 << 30).alias("w2"))).alias("at", "g"),
    ).select("row", "doc_id", "n_words", "at", F.xxhash64("g.w0", "g.w1", "g.w2").alias("h"), "g.w0", "g.w1", "g.w2")
    known = templates(spark, base, notices)
    known = known.withColumn("h", F.xxhash64("t0", "t1", "t2"))
    # A fixed table of a few hundred rows: its bound is the number of templates times 60.
    hits = grams.join(F.broadcast(known), (grams.h == known.h) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "grams", "need", "label", "is_base", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("places")
    )
    text = ["row", "doc_id", "n_words"]
    by_place = Window.partitionBy(*text, "template").orderBy("diagonal")
    # A text without a hit has one vote without a template; all texts go through in one pass.
    near = votes.withColumn(
        "opens", F.when(F.col("diagonal") - F.lag("diagonal").over(by_place) <= SLACK, 0).otherwise(1)
    )
    merged = (
        near.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*text, "template", "run", "grams", "need", "label", "is_base")
        .agg(
            F.bit_or("places").alias("places"),
            F.sum(F.expr("cast(is_base and bit_count(places) = grams as long)")).alias("whole"),
            F.min(F.expr("if(is_base and bit_count(places) = grams, diagonal, null)")).alias("low"),
            F.max(F.expr("if(is_base and bit_count(places) = grams, diagonal, null)")).alias("high"),
        )
        .withColumn("covered", F.expr("if(places & need = need, bit_count(places) / grams, 0d)"))
        .withColumn("says", F.expr(f"(is_base and whole > 0) or (not is_base and covered >= {COVER})"))
        .groupBy(*text)
        .agg(
            F.sum("whole").alias("n_base"),
            F.min("low").cast("long").alias("first_word"),
            F.max("high").cast("long").alias("last_word"),
            F.collect_set(F.expr("if(whole > 0, label, null)")).alias("base_set"),
            F.collect_set(F.expr("if(says, label, null)")).alias("label_set"),
            F.max(F.expr("if(is_base, if(whole > 0, 1d, 0d), covered)")).alias("score"),
        )
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return merged.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined("base_set").alias("base_labels"),
        joined("label_set").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
