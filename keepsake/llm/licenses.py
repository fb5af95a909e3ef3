"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are runs of words that cross line ends, each twice as long as the longest window and begun one
window after the last, so every window lies whole in a block. Templates are the token sets of known
notices. A text meets a template when some window of half as many words again as the template has holds at least ``threshold``
of its distinct tokens (containment) and those that tell it from its kin (``TELLING``). The
join is exact and works with filters on tokens in one global order, rarest first, where a token's
frequency is the number of documents that hold it, counted over all of them:

* prefix: a block that holds a of a template's n tokens, with a at least the needed overlap o,
  holds one of the template's first n - o + 1. Only runs with such a token become blocks, and
  only (block, template) pairs that share one become candidates;
* length: a block with fewer than o tokens of any template is no candidate;
* positions: with the shared prefix token at place i of the template and place j of the block
  (among its tokens that occur in templates at all), at most 1 + min(rest of template, rest of
  block) tokens can be shared.

Survivors are verified window by window, each window begun at a token of the template. Beside this, base phrases are found as runs of words.

Only DataFrame functions are used. The templates are a fixed list in the plan; nothing that grows
with the data is broadcast, and a text is never shuffled.

Edge cases: null or empty text has no words, no labels and score 0; rows are answered one by one,
so repeated rows and null ids keep their own answers. Lines and texts may be of any length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels of the base, and the separators of words.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Notices as their licenses word them (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]
THRESHOLD = 0.8
#: Tokens without which a notice is none of the label: those of them that a template holds must be in the window.
TELLING = {"mit": {"mit"}, "apache-2": {"apache", "2"}, "cc-by-nc": {"nc", "noncommercial"}, "cc-by": {"attribution"}, "gpl-3": {"gnu", "3"}, "mpl-2": {"mozilla", "2"}}


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.sub(NOT_WORD, " ", text.lower()).split()))


def normalised(text: Column) -> Column:
    """The words of a text, each between single spaces, in their own case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def token_frequencies(docs: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """The number of documents that hold each of the given tokens; only their counts reach the driver."""
    alternatives = "|".join(sorted(tokens, key=len, reverse=True))
    held = F.regexp_extract_all(normalised(F.col(text_col)), F.lit(f"(?i)(?<= )({alternatives})(?= )"), F.lit(1))
    rows = docs.select(F.explode(F.array_distinct(F.transform(held, F.lower))).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def ordered_templates(frequencies: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Templates with their tokens as places in the global order, the needed overlap and the prefix."""
    tokens = sorted({t for _, text in templates for t in template_tokens(text)}, key=lambda t: (frequencies.get(t, 0), t))
    place = {t: i for i, t in enumerate(tokens)}
    out = []
    for n, (label, text) in enumerate(templates):
        own = sorted(place[t] for t in template_tokens(text))
        need = math.ceil(threshold * len(own) - 1e-9)
        words = len(re.sub(NOT_WORD, " ", text).split())
        telling = sorted(place[t] for t in TELLING.get(label, set()) & set(template_tokens(text)))
        out.append({"template": n, "label": label, "tokens": own, "need": need, "prefix": own[: len(own) - need + 1], "telling": telling, "width": words + words // 2})
    return out, tokens


def blocks_of(text: Column, width: int) -> Column:
    """Runs of 2 * width words in lower case, one from each width-th word on: any run of width words lies in one of them."""
    letters = F.translate(normalised(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def cut(words):
        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / width).cast("int"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k * width + 1, 2 * width), " "))

    # inside a lambda the words are computed once, not once a block
    return F.get(F.transform(F.array(F.split(F.trim(letters), " ")), cut), F.lit(0))


def _best_window(codes: Column, tokens: Column, telling: Column, width: Column) -> Column:
    """The most distinct tokens of the template in any window that holds its telling ones; 0 if none does."""

    def best(own):
        def step(most, s):
            held = F.array_distinct(F.array_compact(F.slice(own, s + 1, width)))
            return F.when(F.get(own, s).isNull(), most).otherwise(F.greatest(most, F.when(F.size(F.array_except(telling, held)) == 0, F.size(held)).otherwise(0)))

        return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.lit(0), step)

    own = F.transform(codes, lambda c: F.when(F.array_contains(tokens, c), c))
    return F.get(F.transform(F.array(own), best), F.lit(0))


def matches(docs: DataFrame, templates: list[dict], tokens: list[str], key: list[str], text_col: str = "text") -> DataFrame:
    """One row a distinct document (by ``key``), matching block and template: key, template, label, containment."""
    spark = docs.sparkSession
    prefix = "|".join(sorted({tokens[i] for t in templates for i in t["prefix"]}, key=len, reverse=True))
    # prefix filter: only texts, and of these only blocks, with a prefix token
    some = docs.where(F.col(text_col).rlike(rf"(?i)(?<![0-9A-Za-z\x80-\x{{10FFFF}}])({prefix})(?![0-9A-Za-z\x80-\x{{10FFFF}}])"))
    runs = F.filter(blocks_of(F.col(text_col), max(t["width"] for t in templates)), lambda x: x.rlike(rf"(?:^| )(?:{prefix})(?: |$)"))
    order = F.create_map(*[F.lit(x) for i, t in enumerate(tokens) for x in (t, i)])
    codes = F.transform(F.split("run", " "), lambda t: F.when(t.isin(tokens), order[t]))
    blocks = some.select(*key, F.explode(F.array_distinct(runs)).alias("run")).select(*key, codes.alias("codes"))
    blocks = blocks.withColumn("block", F.array_sort(F.array_distinct(F.array_compact("codes"))))
    index = spark.createDataFrame(
        [(t["template"], t["label"], t["tokens"], t["need"], t["telling"], t["width"], p, i) for t in templates for i, p in enumerate(t["prefix"])],
        "template int, label string, tokens array<int>, need int, telling array<int>, width int, token int, i int",
    )
    seeds = blocks.where(F.size("block") >= min(t["need"] for t in templates)).select(*key, "codes", "block", F.posexplode("block").alias("j", "token"))
    candidates = seeds.join(F.broadcast(index), "token").where((F.size("block") >= F.col("need")) & (1 + F.least(F.size("tokens") - 1 - F.col("i"), F.size("block") - 1 - F.col("j")) >= F.col("need")))
    shared = F.array_intersect("tokens", "block")
    # each pair once, by its first shared token
    candidates = candidates.where((F.size(shared) >= F.col("need")) & (F.array_min(shared) == F.col("token")) & (F.size(F.array_except("telling", "block")) == 0))
    best = candidates.select(*key, "template", "label", "need", F.size("tokens").alias("n"), _best_window(F.col("codes"), F.col("tokens"), F.col("telling"), F.col("width")).alias("best"))
    return best.where("best >= need").select(*key, "template", "label", (F.col("best") / F.col("n")).alias("containment")).distinct()


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment; 1 with a base phrase)."""
    all_tokens = sorted({t for _, text in templates for t in template_tokens(text)})
    ordered, tokens = ordered_templates(token_frequencies(docs, all_tokens, text_col), templates, threshold)
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))
    found = (
        matches(keyed, ordered, tokens, ["__id", "__hash"])
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_set("label")).alias("found"), F.max("containment").alias("best"))
        .withColumnsRenamed({"__id": "__found_id", "__hash": "__found_hash"})
    )
    rows = keyed.withColumn("norm", normalised(F.col("text")))
    n_words = F.when(F.col("norm") == "  ", 0).otherwise(_spaces(F.col("norm")) - 1)
    # the words before each place: runs of one phrase never overlap, so cutting at it finds every place
    starts = []
    for phrase in PHRASES:
        cuts = F.split(F.col("norm"), f"(?i) {phrase}(?= )")
        starts.append(F.when(F.size(cuts) > 1, _places(cuts, phrase.count(" ") + 1)).otherwise(F.array().cast("array<int>")))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, label in zip(starts, PHRASES.values(), strict=True)]))))
    rows = rows.select(
        "__id",
        "__hash",
        n_words.cast("long").alias("n_words"),
        F.when(F.col("norm").rlike("(?i) (" + "|".join(PHRASES) + ") "), F.struct(F.concat(*starts).alias("starts"), labels.alias("labels"))).alias("base"),
    )
    out = rows.join(found, rows["__id"].eqNullSafe(found["__found_id"]) & (rows["__hash"] == found["__found_hash"]), "left")
    starts, base = F.coalesce(F.col("base.starts"), F.array().cast("array<int>")), F.coalesce(F.col("base.labels"), F.array().cast("array<string>"))
    found_labels = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found_labels)), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _places(cuts: Column, length: int) -> Column:
    """Word places of a phrase, from the text between its places."""
    first = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(state, cut):
        here = state["n"] + _spaces(cut)
        return F.struct(F.concat(state["at"], F.array(here)).alias("at"), (here + length).alias("n"))

    return F.aggregate(F.slice(cuts, 1, F.size(cuts) - 1), first, step, lambda s: s["at"])


def op1_licenses(spark, sf_dir):
    from keepsake.llm.common import documents

    return scan_licenses(documents(spark, sf_dir))
