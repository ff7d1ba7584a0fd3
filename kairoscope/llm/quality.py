"""Quality rules with DataFrame functions only: base counts, then divergence from language references.

A document's histogram over character classes and its histogram over its language's commonest words (and all other
words together) are compared with the language's own by Jensen-Shannon distance. References are sums over all
documents of the language, rows without a language forming one of their own; every word of every document is
counted (within a task first), and the commonest of each language are taken, ties by the word itself. Character
classes hold every letter: small ones, capitals, letters without case (as of Chinese or Arabic), combining marks,
digits, symbols, and what is left, mostly punctuation. Histograms of few characters or words are noise, so each
comparison has a minimum length below which it passes.

Repeated three-word windows are found in one sort per document: each window's XXH64 with its position in the low
bits (as many as the document needs), so equal windows are neighbours. The hash keeps at least 64 - bits(n) bits;
for a document of n words the chance of a false repeat is about n^2 / 2^(65 - bits(n)), 1e-11 at 600 words.

Defined results: null or empty text has no words, all counts 0, and fails the base rules. Every row is returned
once, repeated rows and null ids too. A language without words has no word distance and passes it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairoscope.llm.common import materialize, named

BLANKS = " \t\n\x0b\x0c\r"
_BLANK = r"[\x20\x09-\x0D]+"
#: Rows of references that are broadcast; with more languages they are joined by a shuffle.
MOST_LANGUAGES = 10_000
#: How many words of each language, its commonest, make up its histogram.
COMMON = 16
CLASSES = ("lower", "upper", "caseless", "mark", "digit", "symbol", "punctuation")


def words(text: Column) -> Column:
    """Maximal runs of what is not one of the six ASCII blanks; none for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = COMMON) -> DataFrame:
    """(l_lang, l_common: hashes of its `most` commonest words), "" for rows without a language."""
    each = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("l_lang"), F.explode(words(F.col(text))).alias("word"))
    counted = each.groupBy("l_lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("l_lang").orderBy(F.desc("n"), "word"))  # the limit goes before its shuffle
    top = counted.withColumn("place", place).where(F.col("place") <= most)
    return top.groupBy("l_lang").agg(F.array_sort(F.collect_list(F.struct("place", F.xxhash64("word").alias("h")))).alias("t")).select("l_lang", F.col("t.h").alias("l_common"))


def _small(lists: DataFrame) -> DataFrame:
    """lists, written once, to be broadcast if they have a bounded number of rows."""
    held = materialize(lists, "references")
    return F.broadcast(held) if held.count() <= MOST_LANGUAGES else held


def measured(docs: DataFrame, common: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] = ("doc_id",), most: int = COMMON) -> DataFrame:
    """The columns `keep`, the base counts, the language, and the two histograms as arrays of counts."""
    lists = common.select("l_lang", F.concat("l_common", F.array_repeat(F.lit(0).cast("bigint"), F.lit(most) - F.size("l_common"))).alias("l_common"), F.size("l_common").alias("l_n"))
    t = F.col("b_text")
    kept = [c.alias(f"k{i}") for i, c in enumerate(named(keep))]
    base = docs.select(*kept, F.coalesce(F.col(lang), F.lit("")).alias("b_lang"), F.coalesce(F.col(text), F.lit("")).alias("b_text"))
    base = base.join(_small(lists), F.col("b_lang") == F.col("l_lang"), "left")
    names = [f"k{i}" for i in range(len(keep))]
    base = base.select(*names, "b_lang", "l_common", "l_n", words(t).alias("w"), F.regexp_replace(t, r"[\p{Ll}\x20\x09-\x0D]+", "").alias("marks"), F.filter(F.split(t, "\n", -1), lambda s: F.btrim(s, F.lit(BLANKS)) != "").alias("lines"))
    long = F.length("marks")
    base = base.select(
        *names, "b_lang", "l_common", "l_n", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), long.alias("m"),
        _count("marks", r"[^#*$%&|<>]+").alias("n_symbols"), _count("marks", r"[^\p{Lu}]+").alias("upper"), _count("marks", r"[^\p{N}]+").alias("digit"), _count("marks", r"[^\p{L}]+").alias("letters"), _count("marks", r"[^\p{M}]+").alias("combining"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    n, bits = F.col("n_words"), F.length(F.bin("n_words"))
    windows = F.transform(F.slice("h", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2)))
    base = base.withColumn("bits", bits).withColumn("windows", windows)
    base = base.withColumn("at", F.sort_array(F.transform("windows", _placed)))
    base = base.withColumn("again", F.filter("at", lambda x, i: (_prefix(F.get("at", i - 1)) == _prefix(x)) | (_prefix(F.get("at", i + 1)) == _prefix(x))))
    base = base.withColumn("places", F.sort_array(F.transform("again", lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1))))
    covered = F.aggregate(F.transform("places", lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("places", i + 1) - x, F.lit(3).cast("bigint")))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # each common word and its successor stand in the sorted hashes as sentinels; their distance counts the word
    c = [F.get("l_common", F.lit(k)) for k in range(most)]
    base = base.withColumn("sorted", F.sort_array(F.concat("h", "l_common", F.transform("l_common", lambda x: x + 1))))
    hist = F.array(*[F.when(F.lit(k) < F.col("l_n"), F.array_position("sorted", c[k] + 1) - F.array_position("sorted", c[k]) - 1).otherwise(0).cast("bigint") for k in range(most)])
    other = F.col("m") - F.col("letters") - F.col("combining") - F.col("digit") - F.col("n_symbols")
    counts = F.array(*[x.cast("bigint") for x in (F.col("word_chars") - F.col("m"), F.col("upper"), F.col("letters") - F.col("upper"), F.col("combining"), F.col("digit"), F.col("n_symbols"), other)])
    out = base.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], F.col("b_lang").alias("lang_ref"), *[F.col(k).cast("bigint").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], covered.alias("n_repeat_words"), counts.alias("chars"), hist.alias("common"))
    return out


def _count(column: str, others: str) -> Column:
    return F.length(F.regexp_replace(column, others, ""))


def _placed(x: Column, i: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", x, F.col("bits")), F.col("bits")).bitwiseOR(i.cast("bigint"))


def _prefix(x: Column) -> Column:
    return F.call_function("shiftright", x, F.col("bits"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if either is empty or all 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    a, b = F.transform(p, lambda x: x / F.nullif(total(p), F.lit(0.0))), F.transform(q, lambda x: x / F.nullif(total(q), F.lit(0.0)))
    terms = F.zip_with(a, b, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms))))


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] = ("doc_id",), least_chars: int = 100, most_chars_js: float = 0.3, least_words: int = 50, most_words_js: float = 0.4) -> DataFrame:
    """The columns `keep` with the base counts, base_failed, js_chars, js_words and kept."""
    held = materialize(measured(docs, common_words(docs, text, lang), text, lang, keep), "quality")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))).cast("bigint") for i in range(n)])
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    with_rest = lambda c, n: F.concat(c, F.array(F.col(n) - total(c)))  # noqa: E731  all other words together
    sent = held.groupBy("lang_ref").agg(sums("chars", len(CLASSES)).alias("r_chars"), sums("common", COMMON).alias("r_common"), F.sum("n_words").alias("r_n"))
    sent = sent.select(F.col("lang_ref").alias("r_lang"), "r_chars", with_rest("r_common", "r_n").alias("r_common"))
    both = held.join(_small(sent), F.col("lang_ref") == F.col("r_lang"), "left").withColumn("common", with_rest("common", "n_words"))
    both = both.withColumn("js_chars", distance(F.col("chars"), F.col("r_chars"))).withColumn("js_words", distance(F.col("common"), F.col("r_common")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    apart = ((F.col("word_chars") >= least_chars) & (F.col("js_chars") > most_chars_js)) | ((F.col("n_words") >= least_words) & (F.col("js_words") > most_words_js))
    return both.select(*named(keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(apart, F.lit(False))).alias("kept"), "js_chars", "js_words")
