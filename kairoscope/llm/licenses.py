"""License scans with DataFrame functions only: Dice coefficient over word bigrams against license templates.

A text is normalised to one sequence of words, its runs of letters and digits, lower-cased; line ends, comment signs
and punctuation do not count, so a notice may be wrapped over lines or stand within one. Its passages for a template of
n words begin at any word pair that the template has and reach to the template's last pair within n words, or within
as many as the size bound allows (a longer wording); the set of word pairs of a passage is compared.

Two sets of a and b pairs reach Dice t only if a * t / (2 - t) <= b <= a * (2 - t) / t, so a passage needs more than
t / (2 - t) of the template's pairs. That prunes three times, losing nothing: leaving out that many of the commonest
pairs leaves a signature, and a text that holds none of any template's signature (as a substring) is done; of the
rest, templates of whose pairs the whole text has too few are out; and so are beginnings that have too few of them
within reach. Full license texts are found by the sentence that grants, which is a template.

A passage names its license unless a better one of another license (of higher Dice; ties: first template, earliest
beginning, longest) overlaps it: versions and families of a license differ by few words, and the closest wording counts.

Defined results: null or empty text has no match. A document reports its best passage and all licenses that are named.
Every row is returned, repeated rows too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import named

# Notices by which works are commonly licensed, each with the identifier of its license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("MIT", "Licensed under the terms of the MIT License."),
    ("Apache-2.0", "Licensed under the terms of the Apache License, Version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License."),
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tag in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-2-Clause"), ("BSD", "BSD-3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("EPL-2.0", "EPL-2.0"),
        ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("LGPL", "LGPL-2.1-only"), ("LGPL", "LGPL-2.1-or-later"), ("LGPL", "LGPL-3.0-only"),
        ("LGPL", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "Unlicense"),
    )],
]

THRESHOLD = 0.8
#: Bounds that are whole numbers may come out a rounding error off; they are widened by more than that.
ROUNDING = 1e-9
_APART = r"[^\p{L}\p{N}]+"


def normalized(text: str) -> list[str]:
    """Words of a template, as words() has them of a column (templates are ASCII)."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def signature(pairs: list[str], everywhere: dict[str, int], threshold: float) -> list[str]:
    """Enough pairs that a passage without any of them cannot match: those with most letters, then of most templates."""
    needed = threshold / (2 - threshold) * len(pairs) - ROUNDING  # a match shares at least so many
    spare = -int(-needed // 1) - 1  # and so may miss all but these
    ranked = sorted(pairs, key=lambda p: (-min(len(p), 12), -everywhere[p], -len(p), p))
    return ranked[: max(1, len(pairs) - max(0, spare))]


def needed(pairs: int, threshold: float) -> int:
    """Pairs that a match shares with a template of so many."""
    return max(1, -int(-(threshold / (2 - threshold) * pairs - ROUNDING) // 1))


def reach(pairs: int, threshold: float) -> int:
    """Pairs of the longest set that can match a template of so many."""
    return int((2 - threshold) / threshold * pairs + ROUNDING)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with license (null without a match), dice (of the best passage), template (its number), first_word and
    n_words (of the passage, in words of the normalised text), licenses (all that are named, sorted)."""
    added = ("license", "dice", "template", "first_word", "n_words", "licenses")
    plain = [c for c in docs.columns if c not in added]
    pairs = [bigrams(normalized(t)) for _, t in templates]
    everywhere: dict[str, int] = {}
    for p in pairs:
        for b in p:
            everywhere[b] = everywhere.get(b, 0) + 1
    # one of these pairs is in any text with a match; few pairs serve many templates
    marks = sorted({b for p in pairs for b in signature(p, everywhere, threshold)})
    # as text: a call for each literal would take longer than the scan of a small table
    rows = [f"named_struct('k', {-k}, 'words', {len(normalized(t))}, 'n', {len(p)}, 'need', {needed(len(p), threshold)}, 'most', {reach(len(p), threshold)}, 'pairs', {_list(p)})" for k, ((_, t), p) in enumerate(zip(templates, pairs))]
    known = F.expr(f"array({', '.join(rows)})")
    # each step in a projection of its own, the row in a struct so that no name clashes
    docs = docs.select(F.struct(*named(plain)).alias("row"), F.lower(F.col(text)).alias("low"))
    docs = docs.select("row", F.trim(F.regexp_replace("low", _APART, " ")).alias("flat"))
    docs = docs.select("row", F.when(F.expr(" OR ".join(f"contains(flat, {_quoted(m)})" for m in marks)), F.col("flat")).alias("flat"))  # null: no match
    none = F.array().cast("array<struct<dice:double,k:int,first:int,n:int>>")
    found = F.when(F.col("flat").isNotNull(), let(_pairs(F.split("flat", " ")), lambda b: F.flatten(F.transform(known, lambda t: _matches(b, t, threshold)))))
    docs = docs.select("row", F.coalesce(found, none).alias("found"))
    # in the order of their beginnings, those that could overlap one lie within so many places of it
    names = F.expr(_list(name for name, _ in templates))
    order = sorted({name for name, _ in templates})
    license_of = F.expr(f"array({', '.join(str(order.index(name)) for name, _ in templates)})")
    placed = F.array_sort(F.transform("found", lambda m: F.struct((-m["first"]).alias("at"), F.get(license_of, -m["k"]).alias("license"), m.alias("m"))))
    docs = docs.select("row", "found", F.array_max("found").alias("best"), placed.alias("placed"))
    around = 2 * len(templates) * max((reach(len(p), threshold) + 1 for p in pairs), default=1)

    def named_by(x: Column, i: Column) -> Column:
        close = F.slice("placed", F.greatest(i + 1 - around, F.lit(1)), F.lit(2 * around + 1))
        return ~F.exists(close, lambda o: (o["license"] != x["license"]) & (o["at"] < x["at"] + x["m"]["n"]) & (x["at"] < o["at"] + o["m"]["n"]) & (o["m"] > x["m"]))

    docs = docs.select("row", "best", F.filter("placed", named_by).alias("named"))
    # ties: the numbers are negative, so the first template and the earliest beginning are the largest
    return docs.select(
        "row.*", F.get(names, -F.col("best.k")).alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.k")).alias("template"), (-F.col("best.first")).alias("first_word"), F.col("best.n").alias("n_words"),
        F.array_sort(F.array_distinct(F.transform("named", lambda x: F.get(names, -x["m"]["k"])))).alias("licenses"),
    )


def _pairs(words: Column) -> Column:
    """Neighbouring words, in order."""
    return let(words, lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))


def _matches(b: Column, t: Column, threshold: float) -> Column:
    """The matching passages of a text's pairs b with the template t, each (dice, -number, -first word, words)."""
    none = F.array().cast("array<struct<dice:double,k:int,first:int,n:int>>")

    def placed(shared: Column) -> Column:
        return let(F.filter(F.transform(b, lambda x, i: F.when(F.array_contains(shared, x), i)), lambda i: i.isNotNull()), beginnings)

    def beginnings(at: Column) -> Column:
        """at: places of the template's pairs. Those with enough of them within reach begin a passage of each length."""
        begun = F.filter(F.transform(at, lambda p, i: F.when(F.get(at, i + t["need"] - 1) < p + t["most"], i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(begun, lambda i: let(F.slice(at, i + 1, t["most"]), lambda near: F.array(*[passage(near, reached) for reached in (t["words"] - 1, t["most"])]))))

    def passage(near: Column, reached: Column) -> Column:
        p = F.get(near, F.lit(0))
        last = F.array_max(F.filter(near, lambda q: q < p + reached))
        own = let(F.array_distinct(F.slice(b, p + 1, last - p + 1)), lambda s: (F.lit(2.0) * F.size(F.array_intersect(s, t["pairs"]))) / (F.size(s) + t["n"]))
        return F.struct(own.alias("dice"), t["k"].alias("k"), (-p).alias("first"), (last - p + 2).alias("n"))

    in_text = let(F.array_intersect(t["pairs"], b), lambda shared: F.when(F.size(shared) >= t["need"], placed(shared)).otherwise(none))
    return F.filter(in_text, lambda m: m["dice"] >= threshold)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(texts: Iterable[str]) -> str:
    return f"array({', '.join(map(_quoted, texts))})"
