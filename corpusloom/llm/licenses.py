"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined to the positions of the same k-grams in the templates: runs of WIDE
words for license texts and notices, pairs for the short phrases of the base. A hit votes for its diagonal, the place in the text
where the template would begin. Votes are summed by text, template and diagonal, neighbouring diagonals are merged (a word put in
or left out moves the rest by one), and what has enough votes is verified word by word against the text.

The template table is fixed and small (its size is that of `TEMPLATES` and license_texts.txt), so it is broadcast.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, keyed, table

#: Phrases with the labels that they give by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of license notices, by label.
TEMPLATES = {
    "agpl": "gnu affero general public license",
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "creative-commons": "creative commons attribution 4.0 international license",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
#: Words of a k-gram, for templates and for phrases of the base.
WIDE, NARROW = 4, 2
#: Diagonals that differ by so much at most are merged; share of a template's words that must stand in the text (all of them
#: in templates below ten words); share of the k-grams that must vote before the words are looked at (all, if all words must stand).
BAND, MATCH, VOTES, SHORT = 2, 0.9, 0.3, 10
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text) if w]


def license_texts() -> dict[str, str]:
    parts = re.split(r"(?m)^== (.+)$", Path(__file__).with_name("license_texts.txt").read_text())[1:]
    return {label: text.lower() for label, text in zip(parts[::2], parts[1::2])}


#: (label, words, whether it is a phrase of the base) by template number.
LIBRARY = [(label, split_words(p), True) for p, label in PHRASES.items()] + [(label, split_words(t), False) for label, t in (TEMPLATES | license_texts()).items()]


def _words():
    # lower() differs from lower-casing A-Z only in characters that are no part of a template and word characters either way
    return F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), NO_WORD), "")


def _run(w, at, k: int):
    """The hash of the k words from a place on."""
    return F.xxhash64(F.lit(k), *(F.get(w, at + j) for j in range(k)))


def seeds(spark: SparkSession) -> DataFrame:
    """(h, template, tpos, n_seeds) of the templates' k-grams."""
    rows = [(t, w, NARROW if base else WIDE) for t, (_, w, base) in enumerate(LIBRARY)]
    n = F.size("w") - F.col("k") + 1
    each = spark.createDataFrame(rows, "template int, w array<string>, k int").select("template", "w", "k", n.alias("n_seeds"), F.explode(F.sequence(F.lit(0), n - 1)).alias("tpos"))
    w, at = F.col("w"), F.col("tpos")
    return each.select(F.when(F.col("k") == NARROW, _run(w, at, NARROW)).otherwise(_run(w, at, WIDE)).alias("h"), "template", "tpos", "n_seeds")


def candidates(docs: DataFrame) -> DataFrame:
    """(k1, k2, template, low, high): texts and bands of diagonals with enough votes."""
    w, at = F.col("w"), F.col("pos")
    places = F.when(F.size(w) >= NARROW, F.sequence(F.lit(0), F.size(w) - NARROW))
    # places are exploded, not lists of hashes: what follows up to the join then is compiled into one loop
    each = keyed(docs).select("k1", "k2", _words().alias("w")).select("k1", "k2", "w", F.explode(places).alias("pos"))
    grams = each.select("k1", "k2", "pos", F.explode(F.array(_run(w, at, NARROW), _run(w, at, WIDE))).alias("h"))
    hits = grams.join(F.broadcast(seeds(docs.sparkSession)), "h").select("k1", "k2", "template", "n_seeds", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).distinct()  # equal texts vote once
    votes = hits.groupBy("k1", "k2", "template", "n_seeds", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    base = F.col("template") < len(PHRASES)
    text = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    new = F.when(base | (F.col("diagonal") - F.lag("diagonal").over(text) > BAND), 1).otherwise(0)
    bands = votes.withColumn("new", new).withColumn("band", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = bands.groupBy("k1", "k2", "template", "n_seeds", "band").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    exact = F.col("n_seeds") < SHORT - WIDE + 1
    return merged.filter(F.when(exact, F.col("votes") >= F.col("n_seeds")).otherwise(F.col("votes") >= VOTES * F.col("n_seeds"))).select("k1", "k2", "template", "low", "high")


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, spans, n_base, first_word, last_word, base_labels, labels, score.

    spans: (label, base, low, high, share) of each verified template, low and high being the word numbers between which it
    begins. score is the best share of a template's words found, 0 without a candidate. Votes of a text count once for all its copies. Null and empty texts have no words
    and no labels (empty strings); equal texts have equal results; repeated rows stay; an empty table gives no rows.
    """
    docs_ = docs.drop("k1", "k2", "n_words", "spans", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    found = candidates(docs_.select("text")).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "low", "high")).alias("found"))
    rows = join_hot(keyed(docs_), found, ["k1", "k2"]).withColumn("w", _words())
    texts = F.array(*(F.split(F.lit(" ".join(words)), " ") for _, words, _ in LIBRARY))
    names = F.array(*(F.lit(label) for label, _, _ in LIBRARY))

    def check(c):
        t = F.get(texts, c["template"])
        at = lambda j, d: F.coalesce(F.get(F.col("w"), d + j) == F.get(t, j), F.lit(False))
        places, band = F.sequence(F.lit(0), F.size(t) - 1), F.sequence(c["low"], c["high"])
        one = F.array_max(F.transform(band, lambda d: F.size(F.filter(places, lambda j: at(j, d)))))
        any_ = F.size(F.filter(places, lambda j: F.exists(band, lambda d: at(j, d))))
        hit = F.when(F.size(t) < SHORT, one).otherwise(any_)  # short ones stand on one diagonal, or not at all
        return F.struct(F.get(names, c["template"]).alias("label"), (c["template"] < len(PHRASES)).alias("base"), c["low"].alias("low"), c["high"].alias("high"), hit.alias("hit"), F.size(t).alias("size"))

    rows = rows.withColumn("checked", F.transform("found", check))
    share = lambda s: s["hit"] / s["size"]
    # of templates of nearly one wording at one place (notices of a family of licenses) the best one counts
    near = lambda s, o: (F.abs(o["low"] - s["low"]) * 4 <= s["size"]) & (F.abs(o["size"] - s["size"]) * 5 <= s["size"]) & (o["size"] >= SHORT)
    beaten = lambda s: (s["size"] >= SHORT) & F.exists("checked", lambda o: near(s, o) & (share(o) > share(s)))
    sure = F.filter("checked", lambda s: F.when(s["base"] | (s["size"] < SHORT), s["hit"] == s["size"]).otherwise((share(s) >= MATCH) & ~beaten(s)))
    rows = rows.withColumn("spans", F.coalesce(sure, F.array().cast("array<struct<label:string,base:boolean,low:int,high:int,hit:int,size:int>>")))
    base = F.filter("spans", lambda s: s["base"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    lows = F.transform(base, lambda s: s["low"])
    return rows.withColumns({
        "n_words": F.size("w").cast("long"), "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(lows).cast("long"), "last_word": F.array_max(lows).cast("long"),
        "base_labels": label(base), "labels": label(F.col("spans")),
        "score": F.coalesce(F.array_max(F.transform("checked", share)), F.lit(0.0)),
    }).drop("k1", "k2", "w", "found", "checked")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op4_license_scan": op4_license_scan}
