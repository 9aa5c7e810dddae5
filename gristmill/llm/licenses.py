"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line of a text, or a run of as many words as the template has, over line ends; both are sets of words. A block
meets a template if it holds at least THRESHOLD of the template's words.
One pass over the texts keeps, of each document, which words of the templates' vocabulary it has, the places of base
phrases, and those blocks that have as many vocabulary words as the least template needs (length filter). Words are
ordered by how many documents have them, rarest first. A block can only meet a template if it shares one of the
template's rarest words (prefix filter: so many that fewer words remain than are needed), and if from the place of the
first shared word in either order enough words remain (positional filter). What passes is verified. Runs are held against
each template beside the row, where a document has enough of its words: a run begins at a word of the template, and only
where as many of them as are needed stand close enough is it verified. No filter loses a block that meets the threshold.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned each; an empty table gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import NOT_ALNUM, materialise

THRESHOLD = 0.8
# The base phrases of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Opening words and notices of public licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _strings(xs: Sequence[str]) -> Column:
    return F.array(*map(F.lit, xs))


def normalised(text: Column) -> Column:
    """Lower case; the Kelvin sign, the one other character that would become an ASCII letter, is kept out of A-Z."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def _word_count(parts: Column) -> Column:
    """Number of non-empty parts: only the first and the last can be empty."""
    return F.size(parts) - (parts[0] == "").cast("int") - F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively. words may begin with one empty part, which counts for none."""
    first, *rest = phrase.split(" ")
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i).otherwise(-1)), lambda i: i >= 0)
    for k, w in enumerate(rest, 1):
        starts = F.filter(starts, _follows(words, k, w))
    shift = (words[0] == "").cast("int")
    return F.transform(starts, lambda i: (i - shift).cast("long"))


def _follows(words: Column, k: int, word: str) -> Callable[[Column], Column]:
    return lambda i: F.get(words, i + k) == word


def _needed(tokens: Sequence[str], threshold: float) -> int:
    return math.ceil(threshold * len(tokens) - 1e-9)


def _template(k: int, label: str, words: Sequence[str], threshold: float) -> Column:
    return F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), _strings(words).alias("words"), F.lit(len(words)).alias("size"), F.lit(_needed(words, threshold)).alias("needed"))


def _run_overlap(hits: Column, text: str, threshold: float) -> Column:
    """The most words of a template that a run of its length holds, null if too few; hits: the (at, word) of a text in its order."""
    n, ws = len(text.split(" ")), sorted(set(text.split(" ")))
    needed = _needed(ws, threshold)

    def run(own: Column) -> Column:
        begun = F.transform(own, lambda x, i: F.struct(i.alias("i"), x["at"].alias("at")))
        near = F.filter(begun, lambda x: F.get(own, x["i"] + (needed - 1))["at"] < x["at"] + n)
        held = F.transform(near, lambda x: F.size(F.array_distinct(F.transform(F.filter(F.slice(own, x["i"] + 1, n), lambda y: y["at"] < x["at"] + n), lambda y: y["word"]))))
        return F.array_max(F.filter(held, lambda k: k >= needed))

    own = F.filter(hits, lambda x: x["word"].isin(*ws))
    return F.transform(F.array(own), run)[0]  # own is a variable in run(), so it is found once for a row


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every document."""
    sets = [(label, sorted(set(text.split(" ")))) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws} | {w for p, _ in phrases for w in p.split(" ")})
    least = min(_needed(ws, threshold) for _, ws in sets)
    d = docs.select("doc_id", normalised(F.col("text")).alias("low"))
    d = d.select("doc_id", "low", F.split("low", NOT_ALNUM + "+").alias("words"))
    d = d.select("doc_id", "low", "words", F.array_intersect("words", _strings(vocabulary)).alias("present"))
    none = F.array().cast("array<bigint>")
    places = [F.when(F.size(F.array_intersect("present", _strings(ps := p.split(" ")))) == len(ps), _places(F.col("words"), p)).otherwise(none) for p, _ in phrases]
    enough = [F.size(F.array_intersect("present", _strings(ws))) >= _needed(ws, threshold) for _, ws in sets]
    could = F.lit(False)
    for e in enough:
        could = could | e
    lines = F.transform(F.split("low", "\n"), lambda x: F.array_sort(F.array_intersect(F.split(x, NOT_ALNUM + "+"), _strings(vocabulary))))
    blocks = F.when(could, F.array_distinct(F.filter(lines, lambda x: F.size(x) >= least))).otherwise(F.array().cast("array<array<string>>"))
    shift = (F.col("words")[0] == "").cast("int")
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct((i - shift).alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    runs = F.transform(F.array(hits), lambda h: F.array(*(F.when(e, _run_overlap(h, text, threshold)) for e, (_, text) in zip(enough, templates, strict=True))))[0]
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", _word_count(F.col("words")).cast("long").alias("n_words"), "present", F.array(*places).alias("places"), blocks.alias("blocks"), F.when(could, runs).alias("runs"))
    d = materialise(d, "licenses")
    # The global order: how many documents have each word.
    seen = d.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    words = docs.sparkSession.range(1).select(F.explode(F.array(*(_template(k, label, ws, threshold) for k, (label, ws) in enumerate(sets)))).alias("t")).select("t.template", "t.label", "t.size", "t.needed", F.explode("t.words").alias("word"))
    ranked = words.join(seen, "word", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    order = Window.partitionBy("template").orderBy("docs", "word")
    index = materialise(ranked.withColumn("t_at", F.row_number().over(order) - 1), "index")  # a row for each word of each template
    prefixes = index.filter("t_at <= size - needed")
    # Blocks: each distinct set of words once for a document, in the global order.
    b = d.select("row", F.posexplode("blocks").alias("block", "tokens"))
    ordered = b.select("row", "block", F.explode("tokens").alias("word")).join(seen, "word").groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("docs", "word"))).alias("ordered"))  # a set of vocabulary words
    ordered = ordered.select("row", "block", F.transform("ordered", lambda x: x["word"]).alias("tokens"))
    met = ordered.select("row", "block", "tokens", F.posexplode("tokens").alias("b_at", "word")).join(prefixes, "word").filter(F.size("tokens") >= F.col("needed"))  # length filter
    first = met.groupBy("row", "block", "template").agg(F.min(F.struct("t_at", "b_at")).alias("at"), F.first("tokens").alias("tokens"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("needed").alias("needed"))
    candidates = first.filter(F.least(F.col("size") - F.col("at.t_at"), F.size("tokens") - F.col("at.b_at")) >= F.col("needed"))
    whole = F.create_map(*(x for k, (_, ws) in enumerate(sets) for x in (F.lit(k), _strings(ws))))
    verified = candidates.withColumn("overlap", F.size(F.array_intersect("tokens", whole[F.col("template")]))).filter("overlap >= needed")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("share"))  # labels of templates
    all_places = F.flatten("places")
    base = F.array_compact(F.array(*(F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))))
    out = d.join(found, "row", "left").withColumn("at", all_places).withColumn("base", F.array_sort(F.array_distinct(base)))
    by_run = F.array_compact(F.array(*(F.when(F.col("runs")[k].isNotNull(), F.lit(label)) for k, (label, _) in enumerate(sets))))
    run_share = F.array_max(F.array(*(F.col("runs")[k] / len(ws) for k, (_, ws) in enumerate(sets))))
    labels = F.array_sort(F.array_union(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))), by_run))
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.greatest("share", run_share), F.lit(0.0))).alias("score"),
    )
