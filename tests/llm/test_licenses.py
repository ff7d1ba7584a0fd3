import random
import re

from kairoscope.llm import licenses

NOTICES = [t for _, t in licenses.TEMPLATES]
TEXTS = [None, "", "plain words only", "license", "\n\n", NOTICES[0], f"some prose\n{NOTICES[5]}\nmore", "LICENSED under: the apache license version 2.0", "Licensed under the Apache Licence", "Released under the new MIT License.", "all rights reserved", "We hold that all rights reserved by law are theirs", f"{NOTICES[4]} extra words here", "x\n" + "\n".join(NOTICES), "This work is licensed under the GNU General Public License, version 3. " * 3, "Ünder the MIT Lïcense"]


def name(m):
    return licenses.TEMPLATES[m[1]][0]


def plain(text):
    """Every passage of every template, nothing pruned."""
    found = []
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    b = [f"{x} {y}" for x, y in zip(w, w[1:])]
    for k, t in enumerate(NOTICES):
        words = licenses.normalized(t)
        own = set(licenses.bigrams(words))
        at = [p for p, x in enumerate(b) if x in own]
        for p in at:
            for reached in (len(words) - 1, int(1.2 / 0.8 * len(own) + 1e-9)):
                last = max(q for q in at if p <= q < p + reached)
                a = set(b[p : last + 1])
                if (dice := 2.0 * len(a & own) / (len(a) + len(own))) >= 0.8:
                    found.append((-dice, k, p, -(last - p + 2)))
    best = min(found, default=None)
    return (*((licenses.TEMPLATES[best[1]][0], -best[0], best[1], best[2], -best[3]) if best else [None] * 5), sorted({name(m) for m in found if not any(name(o) != name(m) and o < m and o[2] < m[2] - m[3] and m[2] < o[2] - o[3] for o in found)}))


def best_of_all_runs(text, k):
    """The best Dice of any run of words whatever with template k."""
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    b, own = [f"{x} {y}" for x, y in zip(w, w[1:])], set(licenses.bigrams(licenses.normalized(NOTICES[k])))
    return max((2 * len(set(b[i:j]) & own) / (len(set(b[i:j])) + len(own)) for i in range(len(b)) for j in range(i + 1, min(len(b), i + 2 * len(own)) + 1)), default=0)


def test_against_every_template_without_pruning(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)] + [(None, NOTICES[2], None, None), (3, "license", "x", 1.0)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, dice double"))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.license, r.dice, r.template, r.first_word, r.n_words, r.licenses) == plain(r.text), r.text
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


MIT = """MIT License

Copyright (c) 2024 Example Corp

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_notices_as_they_stand_in_files(spark):
    """Wrapped over lines, behind comment signs, within a line, in a text of its own words, with some words changed."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("river stone of the house and in light under way".split()) + rng.choice(["", "", "\n"]) for _ in range(n))
    cases = [(MIT, "MIT"), ("This page was written by the team. Released under the MIT License.", "MIT"), ("Copyright (c) 2024 Example Corp. All rights reserved.", "proprietary")]
    for name, t in licenses.TEMPLATES:
        words = t.split()
        wrapped = "".join(w + (" " if (i + 1) % 5 else "\n# ") for i, w in enumerate(words))
        cases += [(f"{prose(200)}\n# {wrapped}\n{prose(200)}", name), (f"{prose(30)} {t} {prose(30)}", name)]
        if len(words) > 24:
            changed = [w for i, w in enumerate(words) if i != 7]
            cases += [(f"{prose(20)} {' '.join([*changed[:12], 'really', 'quite', *changed[12:]])} {prose(20)}", name)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (text, name) in enumerate(cases):
        assert name in got[i].licenses, text
        assert (got[i].license, got[i].dice, got[i].template, got[i].first_word, got[i].n_words, got[i].licenses) == plain(text)
        # no run of words is much better than the passage that was found
        if len(text) < 800:
            assert got[i].dice >= best_of_all_runs(text, got[i].template) - 0.06
    clean = licenses.scan(spark.createDataFrame([(i, prose(300) + " the terms of the license and all rights of the software") for i in range(20)], "doc_id long, text string"))
    assert clean.where("license is not null").count() == 0


def test_each_notice_names_its_own_license_alone(spark):
    more = [("SPDX-License-Identifier: MIT", "MIT"), ("This file is licensed under the terms of the MIT license.", "MIT"), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0")]
    cases = [*[(t, n) for n, t in licenses.TEMPLATES], *more]
    got = {r.k: r.licenses for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, text string")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(cases)} == {t: [n] for t, n in cases}
    two = NOTICES[7] + " " + NOTICES[9]
    assert licenses.scan(spark.createDataFrame([(two,)], "text string")).first().licenses == ["GPL-3.0", "LGPL"]


def test_long_texts_full_of_a_templates_pairs(spark):
    text = "in the software without of the gnu general public to deal in " * 20_000 + NOTICES[4]
    (got,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got.license == "MIT" and got.dice == 1


def test_signatures_lose_nothing():
    pairs = [licenses.bigrams(licenses.normalized(t)) for t in NOTICES]
    for p in pairs:
        mark = licenses.signature(p, {b: 1 for b in p}, 0.8)
        left = len(p) - len(mark)
        # the most a passage without the signature can reach: all other pairs and nothing else
        assert not left or 2 * left / (left + len(p)) < 0.8


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
