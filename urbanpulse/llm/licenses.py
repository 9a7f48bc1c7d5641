"""License phrases and notices in whole texts, by diagonal voting. SQL functions only.

Every template is a run of words. The rolling word grams of all texts are joined, by hash and by their words, to the places
of the same grams in the templates; grams whose hash no template has are left out before the join, inside the row. A hit at word p of a text and word q of a template votes for
the diagonal p - q. Neighbouring diagonals, up to DRIFT apart as words were put in or left out, are merged into one
span, and a span stands if at least COVER of its template's grams are found in it. A template of at most GRAM words is one
gram, is never merged, and so is found exactly where its words stand consecutively.

Equal texts are scanned as often as they occur but voted on once: hits carry the SHA-256 of the text, and repeats fall
together in the map-side part of the aggregate. Texts are not shuffled, only hits are.

Null and empty texts have no words and no spans. Rows that repeat, and rows without doc_id, each give a row. Ties (two
templates at one place) are two spans. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.session import small_side

GRAM = 3
DRIFT = 3
COVER = 0.6

# The phrases asked for, and public notices by the names of their licenses.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit-line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy "
    "modify merge publish distribute sublicense and or sell copies of the software": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation": "gpl-notice",
    "you should have received a copy of the gnu lesser general public license along with": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution": "cc",
}
TEMPLATES = PHRASES | NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"({WORD})"), 1)


def gram_hashes(of: Column) -> Column:
    """One hash for each two words in a row, then one for each three; those that run over the end hash fewer words."""
    single = F.transform(of, lambda w: F.xxhash64(w))
    rest = F.greatest(F.size(of), F.lit(1))
    pairs = F.zip_with(single, F.slice(single, F.lit(2), rest), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(single, F.lit(3), rest), lambda a, b: F.xxhash64(a, b))
    return F.concat(pairs, triples)


def with_grams(rows: DataFrame, keys: list[str], known: Sequence[int] | None = None) -> DataFrame:
    """keys, place, hash and gram of every gram of two and of three words; rows: keys and words.

    With `known` only grams with one of these hashes are unfolded into rows.
    """
    n = F.size("words")
    hashed = rows.select(*keys, "words", gram_hashes(F.col("words")).alias("hashes"))

    def wanted(h: Column, at: Column) -> Column:
        whole = (at % n) + F.when(at < n, 2).otherwise(3) <= n
        return F.when(whole if known is None else h.isin(*known) & whole, at)

    def unfolded(at: Column) -> Column:
        gram = F.slice("words", at % n + 1, F.when(at < n, 2).otherwise(3))
        return F.struct((at % n).alias("place"), F.get("hashes", at).alias("hash"), gram.alias("gram"))

    places = F.filter(F.transform("hashes", wanted), lambda at: at.isNotNull())
    return hashed.select(*keys, F.explode(F.transform(places, unfolded)).alias("g")).select(*keys, "g.*")


def template_grams(spark, templates: Mapping[str, str]) -> DataFrame:
    """template, label, grams, drift, k, q, hash, gram: the grams that templates are searched by; bounded by the literals."""
    if any(len(phrase.split()) < 2 for phrase in templates):
        raise ValueError("a template needs two words")
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, phrase.split())).alias("words"))
            for i, (phrase, label) in enumerate(templates.items())]
    own = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))).withColumn("n", F.size("words"))
    k = F.least(F.col("n"), F.lit(GRAM))
    grams = with_grams(own, ["template", "label", "n"]).where(F.size("gram") == k)
    return grams.select("template", "label", (F.col("n") - k + 1).alias("grams"), F.when(F.col("n") > GRAM, DRIFT).otherwise(0).alias("drift"),
                        k.alias("k"), F.col("place").alias("q"), "hash", "gram")


def text_spans(texts: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """digest, template, label, first_word, last_word, cover of every span found in the texts; texts: digest and words."""
    known = template_grams(texts.sparkSession, templates)
    hashes = sorted({r["hash"] for r in known.select("hash").collect()})  # as many as the templates have grams
    hits = with_grams(texts, ["digest"], hashes).join(F.broadcast(known), ["hash", "gram"])
    diagonals = hits.groupBy("digest", "template", "label", "grams", "drift", "k", (F.col("place") - F.col("q")).alias("diagonal")).agg(
        F.collect_set("q").alias("voted"))
    along = W.partitionBy("digest", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("drift"), F.lit(True))
    numbered = diagonals.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(along))
    merged = numbered.groupBy("digest", "template", "label", "grams", "k", "span").agg(
        F.min(F.col("diagonal") + F.array_min("voted")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("voted") + F.col("k") - 1).alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("found"))
    cover = F.col("found") / F.col("grams")
    return merged.withColumn("cover", cover).where(F.col("cover") >= COVER).select(
        "digest", "template", "label", F.col("first_word").cast("long"), F.col("last_word").cast("long"), "cover")


def own_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))


def license_spans(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, label, first_word, last_word, cover: one row for each span of each document."""
    own = own_texts(docs)
    spans = text_spans(own.select("digest", words(F.col("text")).alias("words")), templates)
    return own.select("doc_id", "digest").join(spans, "digest").select("doc_id", "label", "first_word", "last_word", "cover")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    n_base counts the places of PHRASES; first_word and last_word are their smallest and largest start. labels also has those
    of NOTICES. score is the largest cover of a span, 0 without one.
    """
    own = own_texts(docs)
    spans = text_spans(own.select("digest", words(F.col("text")).alias("words")))
    base = F.col("template") < len(PHRASES)
    listed = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for c, name in (
        (F.when(base, F.col("label")), "base_labels"), (F.col("label"), "labels"))]
    found = spans.groupBy("digest").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"), *listed, F.max("cover").alias("score"))
    told = own.select("doc_id", "digest", F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words"))
    # written first, so that the join deals both sides anew and can split a text that many rows share
    return told.join(small_side(found), "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
