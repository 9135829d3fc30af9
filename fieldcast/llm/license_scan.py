"""License scans: a trained paragraph classifier, confirmed by template comparison.

A candidate is a line that holds the key phrase of a template, and in a block of
lines without a blank one between them each key phrase with up to 60 words on
either side, so that wrapped notices are seen whole. A block's finding counts if
none of its lines has the same family; then its lines' unknowns do not count. Its distinct words and word pairs are the features of a multinomial
logistic regression over the license families and an unknown class, trained
here on the templates, on variants of them with words left out or put in, and
on sentences that only sound like them. A temperature fitted on variants that
were held out calibrates the probabilities. A family stands if its probability
is at least ``min_probability`` and the paragraph holds the key phrase and at
least ``min_share`` of the word pairs of one of the family's templates.

Scoring is plain DataFrame expressions over each row, without a shuffle: the
weights are a literal of fixed size. Only training, on the templates alone,
runs in the driver.

Defined results: null and empty texts, and texts without candidates, have no
licenses. Each paragraph counts by itself, also a repeated one. Ties between
families go to the one that sorts first. Other columns of the input are not
read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import col

MIN_PROBABILITY = 0.5
MIN_SHARE = 0.75
UNKNOWN = "unknown"

# Usual notices of license families, each with the words that every use of it holds.
TEMPLATES = [
    ("agpl-3.0", "affero", "licensed under the GNU Affero General Public License version 3"),
    ("all-rights-reserved", "all rights reserved", "All rights reserved."),
    ("all-rights-reserved", "all rights reserved", "Copyright the author. All rights reserved."),
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache license", "Released under the Apache License 2.0"),
    ("bsd-2-clause", "bsd 2 clause", "Released under the BSD 2-Clause License"),
    ("bsd-3-clause", "bsd 3 clause", "Released under the BSD 3-Clause License"),
    ("bsd-3-clause", "redistribution and use in source and binary forms",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("cc-by-4.0", "cc by 4 0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "creative commons attribution 4 0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0",
     "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0",
     "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "cc0", "Released under CC0 1.0 Universal, dedicated to the public domain"),
    ("gpl-2.0", "gnu general public license", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "lesser general public license", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "mit license", "Licensed under the MIT License"),
    ("mit", "permission is hereby granted",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("unlicense", "free and unencumbered", "This is free and unencumbered software released into the public domain"),
    *((family, "gnu " + name.lower(),
       f"redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
       f"either version {version} of the License, or (at your option) any later version")
      for family, name, version in (("agpl-3.0", "Affero General Public License", "3"), ("gpl-2.0", "General Public License", "2"),
                                    ("gpl-3.0", "General Public License", "3"), ("lgpl-3.0", "Lesser General Public License", "3"))),
    *((family, "spdx license identifier " + " ".join(name.lower().replace("-", " ").replace(".", " ").split()),
       f"SPDX-License-Identifier: {name}")
      for family, names in (("agpl-3.0", "AGPL-3.0-only AGPL-3.0-or-later"), ("apache-2.0", "Apache-2.0"),
                            ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("cc-by-4.0", "CC-BY-4.0"),
                            ("cc-by-nc-4.0", "CC-BY-NC-4.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc0-1.0", "CC0-1.0"),
                            ("gpl-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"), ("gpl-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
                            ("lgpl-3.0", "LGPL-3.0-only LGPL-3.0-or-later"), ("mit", "MIT"), ("mpl-2.0", "MPL-2.0"),
                            ("unlicense", "Unlicense"))
      for name in names.split()),
]
# Sentences that share words with the notices and license nothing.
UNRELATED = [
    "The driver was asked for a license and the version of the form.",
    "Apache licenses a helicopter in this version of the story.",
    "All rights were reserved for the band, and the room was reserved too.",
    "This work is general and public, and the version of it is the third.",
    "The software was released under pressure and a copy of it was permitted.",
    "You need a fishing license in the public park.",
    "The commons are creative and the attribution is open.",
    "Without a license agreement no use in source and binary forms is free of charge.",
    "Please read the license terms before use.",
    "The license of the shop was renewed, with permission granted by the town.",
    "The copyright of the book is held by the author of the work.",
    "Students of MIT wrote the public version under a new name.",
    "A new version is released under the name of the person.",
    "The terms and conditions are subject to the following license.",
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


@lru_cache(1)
def trained() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, weights of each gram by class, biases), divided by the fitted temperature."""
    classes = [*sorted({f for f, *_ in TEMPLATES}), UNKNOWN]
    rng = np.random.default_rng(5)
    stray = sorted({w for t in UNRELATED for w in words_of(t)})
    rows: list[tuple[list[str], int, bool]] = []
    for name, words in [*((f, words_of(t)) for f, _, t in TEMPLATES), *((UNKNOWN, words_of(t)) for t in UNRELATED)]:
        variants = [words, *(words[:k] + words[k + 1:] for k in range(len(words)) if name == UNKNOWN)]
        for _ in range(12):
            extra = [str(x) for x in rng.choice(stray, rng.integers(1, 8))]
            variants.append(extra + words if rng.random() < 0.5 else words + extra)
        rows += [(v, classes.index(name), k > 1 and k % 4 == 0) for k, v in enumerate(variants)]
    for _, _, text in TEMPLATES:  # the words of a notice out of their order are no notice
        rows += [([str(w) for w in rng.permutation(words_of(text))], len(classes) - 1, k == 0) for k in range(3)
                 if len(words_of(text)) > 4]
    whole = [words_of(t) for t in (*(t for *_, t in TEMPLATES), *UNRELATED)]
    vocabulary = {g: k for k, g in enumerate(sorted({g for words in whole for g in grams_of(words)}))}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for i, (v, *_) in enumerate(rows):
        x[i, [vocabulary[g] for g in grams_of(v) if g in vocabulary]] = 1
    x[:, -1] = 1
    y = np.eye(len(classes))[[c for _, c, _ in rows]]
    held = np.array([h for *_, h in rows])
    balance = (1 / y[~held].sum(0))[y[~held].argmax(1)]
    balance *= (~held).sum() / balance.sum()
    w, speed = np.zeros((x.shape[1], len(classes))), 0.0
    softmax = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(600):
        slope = x[~held].T @ (balance[:, None] * (softmax(x[~held] @ w) - y[~held])) / (~held).sum() + 1e-4 * w
        speed = 0.9 * speed - 0.2 * slope
        w = w + speed
    loss = {t: -np.log(softmax(x[held] @ w / t)[y[held] > 0] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
    w /= min(loss, key=loss.get)
    return classes, {g: w[k].round(6).tolist() for g, k in vocabulary.items()}, w[-1].round(6).tolist()


def _list(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _paragraph(text: Column, number: Column, min_probability: float, min_share: float) -> Column:
    """The judgement on one candidate paragraph as a struct."""
    classes, weights, bias = trained()
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")  # folded to a literal map
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    words = F.filter(F.split(padded, " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))),
                        lambda i: F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)))

    def judged(s: Column) -> Column:
        known = F.filter(F.transform(F.array_distinct(F.concat(s["words"], s["pairs"])), lambda g: F.try_element_at(table, g)),
                         lambda v: v.isNotNull())
        logits = F.aggregate(known, _list(bias), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
        # Compared as notices, whatever the class: the best template of each family.
        shares = F.array(*[F.greatest(F.lit(0.0), *[
            F.when(s["padded"].contains(f" {key} "),
                   F.size(F.array_intersect(s["pairs"], F.array(*[F.lit(p) for p in grams]))) / F.lit(len(grams))).otherwise(0.0)
            for f, key, t in TEMPLATES if f == name
            for grams in [list(dict.fromkeys(g for g in grams_of(words_of(t)) if " " in g))]]) for name in classes[:-1]])
        return F.struct(logits.alias("logits"), shares.alias("shares"))

    one = F.struct(padded.alias("padded"), words.alias("words"), pairs.alias("pairs"))
    # Bound through arrays of one element, so that each step is computed once.
    step = F.transform(F.array(one), judged)

    def told(s: Column) -> Column:
        top = F.array_max(s["logits"])
        total = F.aggregate(s["logits"], F.lit(0.0), lambda a, z: a + F.exp(z - top))
        best = F.array_position(s["logits"], top).cast("int")
        name = F.element_at(F.array(*[F.lit(c) for c in classes]), best)
        share = F.coalesce(F.get(s["shares"], best - 1), F.lit(0.0))
        family = F.when((name != UNKNOWN) & (1 / total >= min_probability) & (share >= min_share), name).otherwise(F.lit(UNKNOWN))
        return F.struct(number.alias("paragraph"), family.alias("family"), F.round(1 / total, 6).alias("probability"),
                        F.round(share, 6).alias("template_share"))

    return F.element_at(F.transform(step, told), 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY,
         min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, licenses, n_licenses, n_unknown, findings): the confirmed families of every text.

    ``licenses`` is the sorted distinct families joined by commas; ``findings``
    has each candidate paragraph's number, family or ``unknown``, probability
    and share of the best template.
    """
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    # The longest word of each key phrase: a text without any has no candidate, and is not cut up.
    marks = sorted({max(words_of(key), key=len) for _, key, _ in TEMPLATES})
    keys = sorted({key for _, key, _ in TEMPLATES})

    def any_of(text: Column, phrases: list[str]) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | text.contains(p)
        return found

    plain = lambda p: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")), F.lit(" "))
    held = lambda s: any_of(plain(s["p"]), [f" {k} " for k in keys])
    numbered = F.transform(F.split("text", "\n"), lambda p, i: F.struct(p.alias("p"), i.alias("i"), i.alias("z")))
    lines = F.filter(F.filter(numbered, lambda s: any_of(F.lower(s["p"]), marks)), held)
    # A key phrase in a block of two lines or more, with the words around it.
    parts = F.split("text", "\n[ \\t\r]*\n")
    blocks = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                      lambda s: s["p"].contains("\n") & any_of(F.lower(s["p"]), marks) & held(s))
    around = "((?:[a-z0-9]+ ){0,60}(?:" + "|".join(keys) + ")(?: [a-z0-9]+){0,60})"
    breaks = lambda p: F.size(F.split(p, "\n"))
    windows = F.flatten(F.transform(blocks, lambda s: F.transform(
        F.regexp_extract_all(plain(s["p"]), F.lit(" " + around + " "), F.lit(1)),
        lambda p: F.struct(p.alias("p"),
                           F.when(s["i"] > 0, breaks(F.concat_ws("\n\n", F.slice(parts, 1, s["i"]))) + 1).otherwise(0).alias("i"),
                           breaks(s["p"]).alias("z")))))
    windows = F.transform(windows, lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"), (s["i"] + s["z"] - 1).alias("z")))
    empty = F.array().cast("array<struct<p:string,i:int,z:int>>")
    may = F.coalesce(any_of(F.lower(F.col("text")), marks), F.lit(False))
    found = src.select("doc_id", F.when(may, F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.when(k == 0, lines).otherwise(windows)))
                       .otherwise(F.array(empty, empty)).alias("c"))
    # A row for each candidate, or one for none; put together again inside the row by transform.
    told = F.transform("c", lambda c: F.transform(c, lambda s: F.struct(
        s["z"].alias("z"), _paragraph(s["p"], s["i"], min_probability, min_share).alias("f"))))
    judged = found.select("doc_id", told.alias("told"))
    of_lines, of_blocks = F.col("told")[0], F.col("told")[1]
    inside = lambda b, x: (b["f"]["paragraph"] <= x["f"]["paragraph"]) & (x["f"]["paragraph"] <= b["z"])
    more = F.filter(of_blocks, lambda b: (b["f"]["family"] != UNKNOWN) & ~F.exists(
        of_lines, lambda x: inside(b, x) & (x["f"]["family"] == b["f"]["family"])))
    judged = judged.select("doc_id", of_lines.alias("of_lines"), more.alias("more"))
    left = F.filter("of_lines", lambda x: (x["f"]["family"] != UNKNOWN) | ~F.exists("more", lambda b: inside(b, x)))
    out = judged.select("doc_id", F.transform(F.concat(left, F.col("more")), lambda x: x["f"]).alias("findings"))
    named = F.filter("findings", lambda f: f["family"] != UNKNOWN)
    return out.select(
        "doc_id", F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(named, lambda f: f["family"])))).alias("licenses"),
        F.size(named).cast("long").alias("n_licenses"), (F.size("findings") - F.size(named)).cast("long").alias("n_unknown"),
        "findings")
