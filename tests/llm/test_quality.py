import collections
import math
import random
import re

from kairoscope.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def made():
    rng = random.Random(7)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) + rng.choice(["", "", ".", "\n"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(40, 400)), "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n", "en"), (103, "a b c a b c a b c", "en"), (104, "x " * 3000, "en"), (105, " ".join(f"w{i}***" for i in range(200)), "en"), (106, prose(100).upper(), "en"), (107, "É\xa0é \x1f ünï", None), (None, prose(80), "en"), (0, rows[0][1], "en")]
    return rows


def test_counts_and_distances(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, n_words int, h int")
    got = quality.rules(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, *counts(t)) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[105] and not kept[106]
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 60 and not r.base_failed) == sum(not r.base_failed for r in got if r.doc_id is not None and r.doc_id < 60)
    # distances of one document by hand
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    every = collections.Counter(w for _, t, lang in rows if lang == "en" for w in words(t))
    one = next(r for r in got if r.doc_id == 3)
    own = collections.Counter(words(rows[3][1]))
    top = sorted(every.values(), reverse=True)
    assert top[15] > top[16]
    names = [w for w, n in every.most_common(16)]
    p, q = [own[w] for w in names], [every[w] for w in names]
    assert abs(one.js_words - js([*p, sum(own.values()) - sum(p)], [*q, sum(every.values()) - sum(q)])) < 1e-9


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    pairs = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 1]), ([5, 5], [1, 1]), ([0, 0], [1, 1])]
    got = [r[0] for r in spark.createDataFrame(pairs, "p array<bigint>, q array<bigint>").select(quality.distance(F.col("p"), F.col("q"))).collect()]
    for (p, q), d in zip(pairs[:3], got):
        assert abs(d - js(p, q)) < 1e-9
    assert got[1] == 1 and got[3] is None


def test_native_and_empty(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    plan = quality.measured(docs, quality.common_words(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.rules(docs.limit(0)).count() == 0


def test_caseless_scripts_and_marks_have_classes(spark):
    rows = [(1, "漢字 仮名 " * 30, "zh"), (2, "كتاب جديد " * 30, "ar"), (3, "كِتَاب " * 40, "ar"), (4, "a B 1 # . e\u0301 ǅ ª", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.chars for r in quality.measured(docs, quality.common_words(docs)).collect()}
    assert got[1] == [0, 0, 120, 0, 0, 0, 0] and got[2] == [0, 0, 240, 0, 0, 0, 0] and got[3] == [0, 0, 160, 80, 0, 0, 0]
    assert got[4] == [2, 1, 2, 1, 1, 1, 1]
    far = {r.doc_id: r.js_chars for r in quality.rules(docs).collect()}
    assert far[1] == 0 and min(far[2], far[3]) > 0  # Arabic with and without marks are told apart


def test_words_that_tie_go_by_the_word(spark):
    text = " ".join(f"w{i:02}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, "zz " * 5 + text, "en"), (4, None, "none")], "doc_id long, text string, lang string")
    (row,) = quality.common_words(docs).collect()
    want = spark.createDataFrame([(w,) for w in ["zz", *[f"w{i:02}" for i in range(15)]]], "w string").selectExpr("xxhash64(w)").collect()
    assert row.l_common == [r[0] for r in want]


def test_references_of_many_languages_are_joined_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 7} the of " * 20, f"l{i % 5}") for i in range(50)], "doc_id long, text string, lang string")
    want = sorted(quality.rules(docs).collect())
    monkeypatch.setattr(quality, "MOST_LANGUAGES", 2)
    assert sorted(quality.rules(docs).collect()) == want
