"""License scans by diagonal voting, in DataFrame operations alone.

Every place of every text gives the hash of the words that begin there, in two lengths. They are joined with the same hashes of known
phrases and notices. A match votes for the diagonal on which the template would begin in the text; neighbouring diagonals of a notice
are merged, as a word more or less shifts what follows, up to DRIFT in all. The span they cover is then verified: of the grams that
matched only the longest series counts that stands in the notice's own order, and its share of the notice is the score.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that name a license, and their labels. Each place of one counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short grants of well-known licenses.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
#: What the terms of a family of licenses are called, and its versions; each license is some terms in their order.
TERMS = {"by": ["attribution"], "nc": ["noncommercial", "non commercial"], "sa": ["sharealike", "share alike"], "nd": ["noderivatives", "noderivs", "no derivatives", "no derivs"]}
FAMILY = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
VERSIONS = ["4 0", "3 0", "2 5", "2 0"]
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals of a notice that are no further apart are one, and this share of its grams, in order, makes it a finding.
DRIFT, SHARE = 16, 0.5
#: Names of licenses that differ in a word or two, and their labels. A share of a name says nothing, so all its words must stand consecutively,
#: up to the version, which tells `by` from `by-sa`; one without a version is not found.
NAMES = {
    f"{' '.join(words)} {version}": f"cc-{label}"
    for label in FAMILY for version in VERSIONS
    for words in [("cc", *label.split("-")), *(("creative commons", *spelled) for spelled in product(*(TERMS[t] for t in label.split("-"))))]
}
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_text(text: Column) -> Column:
    """A text cut at what is no letter or digit, A-Z lowered. Other letters are lowered too, which changes neither the number of words
    nor what matches."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR)


def words_of(parts: Column) -> Column:
    """The words among the parts: only the first and the last part can be empty."""
    first = F.when(parts[0] == "", 2).otherwise(1)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.size(parts) - last - first + 1, F.lit(0)))


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], names: dict[str, str]) -> DataFrame:
    """template, phrase (whether its words must stand consecutively), base (whether it is of the given phrases), label, grams (how many it
    has), length, h, words and at (where the gram begins). Names have NOTICE_GRAM words at least."""
    rows = []
    kinds = [(True, True, text, label, PHRASE_GRAM) for text, label in phrases.items()] + [(False, False, text, label, NOTICE_GRAM) for label, text in notices.items()]
    kinds += [(True, False, text, label, NOTICE_GRAM) for text, label in names.items()]
    for k, (phrase, base, text, label, size) in enumerate(kinds):
        words = text.split()
        rows += [(k, phrase, base, label, len(words) - size + 1, len(words), " ".join(words[i : i + size]), i) for i in range(len(words) - size + 1)]
    # as many rows as the templates have words
    frame = spark.createDataFrame(rows, "template int, phrase boolean, base boolean, label string, grams int, length int, gram string, at int")
    return frame.withColumn("h", F.xxhash64("gram"))


def in_order(hits: str) -> Column:
    """Of the hits (pos, at) the longest series in which both rise. The state holds, for each length, the series found so far that ends at
    the smallest `at`."""
    ends = lambda series: F.element_at(series, -1)["at"]

    def step(state: Column, hit: Column) -> Column:
        shorter = F.filter(state, lambda x: ends(x) < hit["at"])
        series = F.concat(F.when(F.size(shorter) > 0, F.element_at(shorter, -1)).otherwise(F.slice(F.array(hit), 1, 0)), F.array(hit))
        return F.concat(shorter, F.array(series), F.slice(state, F.size(shorter) + 2, F.size(state)))

    kind = "array<array<struct<pos:int,at:int>>>"
    # Hits of one place are taken from the last to the first, so that only one of them can join a series.
    falling = F.array_sort(hits, lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(b["at"] - a["at"]))
    return F.aggregate(falling, F.array().cast(kind), step, lambda state: F.when(F.size(state) > 0, F.element_at(state, -1)).otherwise(F.array().cast("array<struct<pos:int,at:int>>")))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, names: dict[str, str] = NAMES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and notices (label, first and last word of each notice
    or name found) for each row of docs (doc_id, text).

    A phrase or a name is found where its words stand consecutively. labels also has those of names, and of notices of which SHARE is
    there. score is 1 where a phrase or a name was found, else the largest share of a notice. A null text is empty; an empty text has no words and no labels ('');
    rows that repeat come out each; other columns are ignored; an empty table gives no rows."""
    templates = template_grams(docs.sparkSession, phrases, notices, names)
    # All rows of a text carry its id and hash, so texts that share an id stay apart; a text in two rows counts twice and comes out twice.
    # Words are split in one projection and used in the next, or they would be split again for every use.
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), split_text(F.col("text")).alias("parts"))
    split = split.select("doc_id", "th", words_of(F.col("parts")).alias("words"))
    places = split.select("doc_id", "th", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    one, two, three = (F.try_element_at("words", F.col("pos") + k) for k in (2, 3, 4))
    grams = places.select(
        "doc_id", "th", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"),
        F.explode(F.array(F.when(F.coalesce("pos", F.lit(0)) == 0, ""), F.concat(F.col("word"), F.lit(" "), one), F.concat(F.col("word"), F.lit(" "), one, F.lit(" "), two, F.lit(" "), three))).alias("gram"),
    )
    # The empty gram of the first word stands for the text itself.
    grams = grams.where("gram is not null").withColumn("hash", F.xxhash64("gram"))
    # The templates' rows are bounded by the templates, not by the data.
    joined = grams.join(F.broadcast(templates.withColumnRenamed("gram", "words")), (F.col("hash") == F.col("h")) & (F.col("gram") != ""), "left")
    # verified on the words themselves
    hits = joined.where("gram = '' or gram = words").select("doc_id", "th", "n_words", "template", "phrase", "base", "label", "grams", "length", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = hits.groupBy("doc_id", "th", "n_words", "template", "phrase", "base", "label", "grams", "length", "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("seen"))
    key = ["doc_id", "th", "n_words"]
    by = Window.partitionBy(*key, "template").orderBy("diagonal")
    # A phrase must stand as it is. Of a notice, each diagonal is taken with those up to DRIFT behind it: as many hits as the notice has
    # grams for each of them at most.
    pairs = F.transform("seen", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), at.alias("at")))
    near = votes.withColumn("hits", F.flatten(F.collect_list(F.when(~F.col("phrase"), pairs)).over(by.rangeBetween(0, DRIFT))))
    aligned = near.withColumn("line", F.when(F.col("phrase"), F.array()).otherwise(in_order("hits")))
    found = F.when(F.col("phrase"), F.size("seen")).otherwise(F.size("line"))
    rated = aligned.select("*", found.alias("found"), F.when(~F.col("phrase"), F.greatest("diagonal", F.lit(0))).alias("from"))
    # Of diagonals that share hits the one with the longest series stands for all; of equal ones the first.
    rank = F.struct("found", (-F.col("diagonal")).alias("first"))
    best = F.col("phrase") | (rank == F.max(rank).over(by.rangeBetween(-DRIFT, DRIFT)))
    merged = rated.select("*", best.alias("best")).where("template is null or best").withColumn("first", F.col("diagonal"))
    share = F.col("found") / F.col("grams")
    whole = F.col("base") & (share == 1)
    named = F.col("phrase") & ~F.col("base") & (share == 1)
    notice = ~F.col("phrase") & (share >= SHARE)
    begin = F.when(F.col("phrase"), F.col("first")).otherwise(F.get(F.sort_array("line"), F.lit(0))["pos"])
    end = F.when(F.col("phrase"), F.col("first") + F.col("length") - 1).otherwise(F.element_at(F.sort_array("line"), -1)["pos"] + NOTICE_GRAM - 1)
    text = merged.groupBy(*key).agg(
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("copies"),
        F.sum(F.when(whole, F.col("votes") / F.col("grams"))).alias("places"),
        F.min(F.when(whole, F.col("first"))).alias("first_word"),
        F.max(F.when(whole, F.col("first"))).alias("last_word"),
        F.collect_set(F.when(whole, F.col("label"))).alias("base"),
        F.collect_set(F.when(notice | named, F.col("label"))).alias("more"),
        F.max(F.when(~F.col("phrase") | named, share)).alias("share"),
        F.sort_array(F.collect_set(F.when(notice | named, F.struct("label", begin.alias("first"), end.alias("last"))))).alias("notices"),
    )
    joined_labels = lambda c: F.concat_ws(",", F.sort_array(c))
    each = text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.round(F.col("places") / F.col("copies")), F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.array_union("base", "more")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "notices",
    )
