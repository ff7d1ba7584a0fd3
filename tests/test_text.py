import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kairoscope.functions import fuzzy
from kairoscope.functions import text as T


def values(spark, f, rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_transcript_form(spark):
    rows = ["الصُّورة", "مرئي", "A-b_c", "  Two  spaces\x1c!", "ـــمـد", None, "Straße"]
    assert values(spark, T.normalize_transcript, rows) == ["الصوره", "مريي", "a b_c", "two spaces", "مد", None, "straße"]


def test_entity_and_evidence_forms(spark):
    assert values(spark, T.normalize_entity, ["Straße", "ﬁn", "a  b ", "إلى"]) == ["strasse", "fin", "a b", "الي"]
    assert values(spark, T.normalize_evidence, ["A, b-c!", "عَرَبي"]) == ["a b c", "عربي"]


def test_terms_words_and_stems(spark):
    assert values(spark, T.query_terms, ["الذكاء"]) == [sorted(["الذكاء", "ذكاء"])]
    assert sorted(values(spark, T.query_words, ["معًا"])[0]) == sorted(["مع", "ا"])
    assert values(spark, T.light_stem, ["الذاتي", "ذاتيا", "انا"]) == ["ذاتي", "ذاتي", "انا"]


def test_citations(spark):
    allowed = F.array(*map(F.lit, ["S1", "S2", "S3"]))
    assert values(spark, lambda t: T.citations(t, allowed), ["x [s 2] y 【S1】 (S2) [S9]", "none", None]) == [["S2", "S1"], [], None]
    assert values(spark, T.is_list_question, ["اذكر الأنواع", "hello"]) == [True, False]


def test_orders(spark):
    df = spark.createDataFrame([("a uses b", "a", "uses", "b"), ("b uses a", "a", "uses", "b"), ("uses a b", "a", "uses", "b"), ("aa", "a", "a", "a")], "e string, s string, p string, o string")
    got = df.select(T.in_order(F.col("e"), F.col("s"), F.col("p"), F.col("o"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    words = spark.createDataFrame([(["x", "a", "b", "c"], ["a", "b"], ["c"]), (["a", "c", "b"], ["a", "b"], ["c"]), (["a"], ["a"], ["a"]), (["a"], ["a"], [])], "w array<string>, p array<string>, q array<string>")
    assert [r[0] for r in words.select(T.tokens_in_order(F.col("w"), F.col("p"), F.col("q"))).collect()] == [True, False, False, False]


def plain_tokens(text):
    return set("".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split())


def plain_coverage(query, text, near):
    q, t = plain_tokens(query), plain_tokens(text)
    if not q or not t:
        return 0.0
    hit = 0
    for a in q:
        if a in t or (near and len(a) >= 4 and any(a[0] == b[0] and abs(len(a) - len(b)) <= 1 and SequenceMatcher(None, a, b).ratio() >= 0.8 for b in t)):
            hit += 1
    return hit / len(q)


def test_ratios_are_those_of_sequence_matcher():
    rng = random.Random(12)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    pairs = [(word("ab", 9), word("ab", 9)) for _ in range(20_000)] + [(word("abcdé漢😀", 16), word("abcdé漢😀", 16)) for _ in range(60_000)]
    for _ in range(20_000):  # near ones, as tokens are
        w = word("aeinrst", 14)
        i = rng.randrange(len(w) + 1)
        pairs.append((w, w[:i] + word("aeinrst", 3) + w[i + rng.randrange(2) :]))
    pairs += [("", ""), ("", "a"), ("x" * 300, "x" * 299 + "y"), ("ab" * 40, "ba" * 40)]
    got = fuzzy.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert [x for x, r in zip(pairs, got.tolist()) if r != SequenceMatcher(None, *x).ratio()] == []
    assert len(fuzzy.ratios([], [])) == 0


@pytest.mark.parametrize("near", [False, True])
def test_coverage_against_a_plain_version(spark, near):
    rng = random.Random(2)
    stems = ["explain", "exits", "river", "stone", "lights", "cat", "housing"]
    word = lambda: (lambda w: w[: rng.randrange(2, 9)] + rng.choice(["", "s", "x", "ed"]))(rng.choice(stems))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, None), (98, "explains exit"), (97, "cut")]
    asked = [(i, " ".join(word() for _ in range(rng.randrange(4)))) for i in range(20)] + [(50, "explain exit"), (51, "cat"), (52, None)]
    a, b = spark.createDataFrame(docs, "doc long, said string"), spark.createDataFrame(asked, "q long, asked_text string")
    got = {(r.q, r.doc): r.coverage for r in fuzzy.coverage(a, b, "doc", "said", "q", "asked_text", near).collect()}
    for d, said in docs:
        for q, text in asked:
            assert abs(got.get((q, d), 0.0) - plain_coverage(text or "", said or "", near)) < 1e-9, (text, said)
    if near:
        assert got[50, 98] == 1.0 and (51, 97) not in got


def test_edit_distance_filter_loses_no_ratio():
    rng = random.Random(3)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))
        b = "".join(rng.choice("abc") for _ in range(len(a) + rng.randrange(-1, 2)))
        if SequenceMatcher(None, a, b).ratio() >= 0.8:
            assert edits(a, b) <= (0.2 * (len(a) + len(b)) + 1e-9) // 1
