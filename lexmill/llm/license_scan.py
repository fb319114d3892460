"""License scanning with DataFrame expressions only.

A sparse multinomial logistic regression over word 1- and 2-grams is trained on the driver from the notices below, on
shortened variants of them and on plain sentences (class ``none``).  Its weights, a table bounded by the notices' grams,
are joined by broadcast.  Every paragraph (lines up to a blank one), every sentence of it with its wrapped lines joined and
every line of a sentence is scored, but for those that cannot but be ``none`` by the weights themselves: a text without
any of the grams in ``needed`` has less licence weight than the bias for ``none``.  Of a paragraph, its sentences and
their lines those are reported that are most like a notice.  The class ``unknown`` is calibrated: the least probability at which held-out
variants of the notices are still right becomes the threshold, below which a licence-like segment is unknown.  A
prediction is confirmed if the text shares enough words with a notice of the family.

Versions are words of the notices like others, so families that share their text but for a version or a word (GNU licences,
Creative Commons) are parted by the weights of these.  Null and empty texts have no segment; very long texts are cut into
paragraphs, sentences and lines as any other.  Of classes of equal weight the first wins.  Rows that repeat are reported each.
Null ids are allowed.  An empty table gives no row.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_UNDER = "This work is licensed under the GNU {0}, version {1}."
_SHORT = "Released under the GNU {0}, version {1}."
#: Public notices by family; the driver trains on them.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under Apache 2.0."],
    "mit": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "This project is licensed under the terms of the MIT license.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED AS IS",
    ],
    **{
        f"{kind}-{version}{'' if '.' in version else '.0'}": [x.format(name, version) for x in (_UNDER, _GPL, _SHORT)] + [f"Licensed under the {kind.upper()}-{version}{'' if '.' in version else '.0'}.", f"GNU {kind.upper()} version {version}"]
        for kind, name, version in (
            ("gpl", "General Public License", "2"), ("gpl", "General Public License", "3"), ("lgpl", "Lesser General Public License", "2.1"),
            ("lgpl", "Lesser General Public License", "3"), ("agpl", "Affero General Public License", "3"),
        )
    },
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Distributed under the BSD 3-Clause License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without written permission."],
}
PLAIN = [
    "The license plate of the car was hard to read.", "He asked for permission to leave the room early.", "All the people in the room were quiet.",
    "Rights and duties go together in a free society.", "The general public was invited to the opening.", "Work on the bridge will be finished next year.",
    "The source of the river lies in the mountains.", "This story is about a boy and his dog.", "They released the prisoners after a long trial.",
    "She reserved a table for two.", "The new version of the song is better.", "Terms of the treaty were agreed upon in spring.",
    "The law of the land is the same for all.", "The public library is open to any person.", "A later version of the program will be shown in the evening.", "The author of the book was not known.",
    "It is free for children under seven.", "The work was published in three parts.", "The general was of the same opinion.", "Copies of the book were sent to all members.", "This is without doubt the best use of time.",
    "Software and hardware are both needed.", "A copy of the letter was found in the attic.", "The driver had no licence and no warranty for the vehicle.",
]
#: Frequent words, first the most frequent: alone they are no grams, and the prefilter does without grams that hold them as
#: far as it may.
COMMON = "the of and a to in is it that with or as this be not no for on are from at was an you can all any may use by".split()
#: Paragraphs are parted by lines without a letter or digit.
PARAGRAPH, SENTENCE, LINE = r"\n(?:[^\p{L}\p{N}\n]*\n)+", r"(?<=[.;!?])\s+", r"\n+"
WORD, CONFIRM = r"[^a-z0-9.+]+", 0.6


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(WORD, text.lower())) if w]


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _variants(text: str, rng, n: int = 12) -> list[list[str]]:
    words, out = _words(text), []
    for _ in range(n):
        keep = [w for w in words if rng.random() > 0.12]
        out.append((keep or words) + [f"~{int(rng.integers(1000))}" for _ in range(int(rng.integers(4)))])
    return [words, *out]


def train(seed: int = 7) -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(classes, gram weights, bias, threshold of the unknown class)."""
    rng = np.random.default_rng(seed)
    classes = [*NOTICES, "none"]
    rows = [(c, v) for c in NOTICES for t in NOTICES[c] for v in _variants(t, rng)] + [("none", v) for t in PLAIN for v in _variants(t, rng)]
    seen = Counter(g for _, v in rows for g in _grams(v) if "~" not in g)
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n > 2 and not set(g.split()) <= set(COMMON)))}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, (_, v) in enumerate(rows):
        for g in _grams(v):
            if g in vocabulary:
                x[i, vocabulary[g]] = 1
    y = np.eye(len(classes))[[classes.index(c) for c, _ in rows]]
    held = np.arange(len(rows)) % 5 == 0
    w = np.zeros((x.shape[1], len(classes)))
    soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(400):
        w += 0.5 * (x[~held].T @ (y[~held] - soft(x[~held] @ w)) / (~held).sum() * 4 - 1e-3 * w)
    p = soft(x[held] @ w)
    right = p.argmax(1) == y[held].argmax(1)
    threshold = float(np.clip(np.quantile(p.max(1)[right], 0.02), 0.3, 0.9))
    return classes, {g: w[i].tolist() for g, i in vocabulary.items()}, w[-1].tolist(), threshold


def needed(classes: list[str], weights: dict[str, list[float]], bias: list[float]) -> set[str]:
    """Grams of which a text has at least one unless its class is none.

    All other grams together have in no class more weight above that for none than the bias for none is above the class's.
    """
    none = classes.index("none")
    gain = {g: np.maximum(0, np.delete(np.array(w) - w[none], none)) for g, w in weights.items()}
    gain = {g: v for g, v in gain.items() if v.max() > 0}
    left = np.delete(bias[none] - np.array(bias), none) - 1e-6
    if left.min() <= 0:
        raise ValueError("a text without words would be a notice")
    rank = {w: i for i, w in enumerate(COMMON)}
    order = sorted(gain, key=lambda g: (max(rank.get(w, len(rank)) for w in g.split()), " " in g, (gain[g] / left).max(), g))
    out = set(gain)
    for g in order:
        if (gain[g] <= left).all():
            left = left - gain[g]
            out.discard(g)
    return out


def _pattern(grams: set[str]) -> str:
    """Matches, in lower case, every text with one of the grams (and some more, as parts of longer words with dots).

    Alternatives that begin alike share their beginning, so a word is told from all of them in a few steps.
    """
    alone = {g for g in grams if " " not in g}
    each = sorted(alone | {g for g in grams if " " in g and alone.isdisjoint(g.split())})
    root: dict = {}
    for g in each:
        at = root
        for ch in g:
            at = at.setdefault("[^a-z0-9+]+" if ch == " " else re.escape(ch), {})
        at[""] = {}

    def written(node: dict) -> str:
        out = [atom + written(then) for atom, then in node.items() if atom]
        if "" in node:
            out.append("")
        return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"

    return "(?<![a-z0-9+])" + written(root) + "(?![a-z0-9+])"


def _units(docs: DataFrame, pattern: str) -> DataFrame:
    """row, doc_id, segment, paragraph, sentence, level (0 line, 1 sentence of several lines, 2 paragraph of several sentences), body."""
    text = F.regexp_replace("text", r"\r\n?", "\n")

    def pieces(p, k):
        sentences = F.split(p, SENTENCE)

        def lines(s, i):
            parts = F.split(s, LINE)
            return F.transform(
                parts,
                lambda x, j: F.struct(
                    k.alias("paragraph"), i.alias("sentence"), x.alias("line"),
                    F.when((j == 0) & (F.size(parts) > 1), s).alias("joined"), F.when((i == 0) & (j == 0) & (F.size(sentences) > 1), p).alias("whole"),
                ),
            )

        return F.flatten(F.transform(sentences, lines))

    found = docs.filter(F.lower("text").rlike(pattern)).select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = found.select("row", "doc_id", F.posexplode(F.flatten(F.transform(F.split("text", PARAGRAPH), pieces))).alias("segment", "x"))
    bodies = F.posexplode(F.array("x.line", "x.joined", "x.whole")).alias("level", "body")
    return found.select("row", "doc_id", "segment", "x.paragraph", "x.sentence", bodies).filter(F.lower("body").rlike(pattern))


def _resolved(found: DataFrame) -> DataFrame:
    """A sentence in place of its lines, a paragraph in place of its sentences, where the larger is more like a notice."""
    like = F.struct("sure", "similarity", "shared")
    lines, sentences = Window.partitionBy("row", "paragraph", "sentence"), Window.partitionBy("row", "paragraph")
    best = lambda level, w: F.max(F.when(level, like)).over(w)
    found = found.withColumn("_in", best(F.col("level") == 0, lines)).withColumn("_out", best(F.col("level") == 1, lines))
    joined = F.col("_out").isNotNull() & (F.col("_in").isNull() | (F.col("_out") > F.col("_in")))
    found = found.filter((F.col("level") == 2) | (joined == (F.col("level") == 1)))
    found = found.withColumn("_in", best(F.col("level") < 2, sentences)).withColumn("_out", best(F.col("level") == 2, sentences))
    whole = F.col("_out").isNotNull() & (F.col("_in").isNull() | F.col("_out.sure") & (F.col("_out") > F.col("_in")))
    return found.filter(whole == (F.col("level") == 2))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, segment, family (or unknown), probability, similarity, confirmed; one row for each notice.

    segment: 0-based number of its first line, lines being cut at sentence ends.
    """
    spark = docs.sparkSession
    classes, weights, bias, threshold = train()
    table = spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(classes))))
    rows = _units(docs, _pattern(needed(classes, weights, bias)))
    words = F.filter(F.transform(F.split(F.lower("body"), WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    known = F.array(*map(F.lit, sorted({w for texts in NOTICES.values() for t in texts for w in _words(t)})))
    ids = ["row", "doc_id", "segment", "paragraph", "sentence", "level"]
    rows = rows.select(*ids, words.alias("words"))
    # Of the words only those of notices, and how many others there are, go on to the comparison with notices.
    rows = rows.select(*ids, "words", F.array_intersect("words", known).alias("known"), F.size(F.array_distinct("words")).alias("n"))
    ids += ["known", "n"]
    pairs = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    grams = rows.select(*ids, F.explode(F.array_distinct(F.concat("words", F.slice(pairs, 1, F.greatest(F.size("words") - 1, F.lit(0)))))).alias("gram"))
    z = [F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"z{i}") for i in range(len(classes))]
    # The table has the grams of the notices above only.
    summed = grams.join(F.broadcast(table), "gram").groupBy(*ids).agg(*z)
    logits = F.array(*[F.col(f"z{i}") + F.lit(bias[i]) for i in range(len(classes))])
    top = F.array_max("logits")
    share = F.expr("1 / aggregate(logits, 0D, (a, x) -> a + exp(x - array_max(logits)))")
    named = summed.select(*ids, logits.alias("logits")).select(
        *ids, share.alias("probability"), F.get(F.array(*map(F.lit, classes)), F.array_position("logits", top).cast("int") - 1).alias("best")
    )
    alike = F.struct(F.lit(0.0).alias("similarity"), F.lit(0).alias("shared"))
    for family, notices in NOTICES.items():
        sets = [sorted(set(_words(t))) for t in notices]
        common = [F.size(F.array_intersect("known", F.array(*map(F.lit, s)))) for s in sets]
        each = [F.struct(F.round(2.0 * c / (F.col("n") + F.lit(len(s))), 6).alias("similarity"), c.alias("shared")) for c, s in zip(common, sets, strict=True)]
        alike = F.when(F.col("best") == family, F.greatest(*each) if len(each) > 1 else each[0]).otherwise(alike)
    out = named.filter(F.col("best") != "none").withColumn("alike", alike).select("*", "alike.*")
    out = _resolved(out.withColumn("sure", (F.col("probability") >= threshold) & (F.col("similarity") >= CONFIRM)))
    family = F.when(F.col("probability") >= threshold, F.col("best")).otherwise("unknown")
    return out.select("doc_id", "segment", family.alias("family"), F.round("probability", 6).alias("probability"), "similarity", F.col("sure").alias("confirmed"))
