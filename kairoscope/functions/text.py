"""Text functions as column expressions. Python runs only for NFKC and case folding, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks and letters that normalisation drops or unifies, and the list-question words.
DIACRITICS = "[ً-ٰٟ]"
TATWEEL = "ـ"
ARABIC = r"[\x{600}-\x{6ff}]"
SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
WORD = r"[\p{L}\p{N}_]+"
CITATION = r"[\[【(]\s*[Ss]\s*(\d+)\s*[\]】)]"
LIST_QUESTION = "أنواع|نوع|فئات|تصنيفات|أقسام|اذكر|عدّد"
VISUAL_CUES = (
    "صورة الصورة صوره الصوره صور الصور لقطة اللقطة لقطه اللقطه مشهد المشهد منظر المنظر شكل الشكل يظهر تظهر شاهد مرئي بصري "
    "خلفية الخلفية لون اللون الوان شاشة الشاشة مكتوب مكتوبة عنوان شعار وجه photo image picture frame scene visual shows showing "
    "appears background color logo screenshot"
).split()
AUDIO_CUES = (
    "قال قالت يقول تقول ذكر يذكر يتحدث تحدث كلام الكلام كلمة الكلمة كلمات العبارة عبارة جملة نص النص صوت الصوت سمع مسموع منطوق "
    "نطق التفريغ تفريغ transcript speech audio spoken said says voice quote quoted"
).split()
MIXED_CUES = "مختلط مختلطة معا mixed multimodal".split()
# The smaller lists by which fused search weighs its two rankings and strips a query.
FUSION_VISUAL_CUES = "صورة صوره الصورة الصوره صور مشهد المشهد لقطة لقطه اللقطة اللقطه يظهر تظهر شكل رسم".split()
FUSION_AUDIO_CUES = "قال يقول تقول ذكر يذكر يتحدث تحدث كلام الكلام كلمة العبارة عبارة صوت الصوت سمع منطوق نطق".split()
# Letters that transcripts spell in several ways, and how search spells them.
SPELLING = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}


def _each_once(text: pd.Series, change: Callable[[str], str]) -> pd.Series:
    """change() of each string, called once for each distinct one of a batch; null stays null."""
    number, distinct = pd.factorize(text)
    changed = np.array([*map(change, distinct), None], dtype=object)  # nulls have number -1
    return pd.Series(changed[number], index=text.index)


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return _each_once(text, lambda s: unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(StringType())
def _casefolded(text: pd.Series) -> pd.Series:
    return _each_once(text, str.casefold)


def _unless_ascii(text: Column, change: Callable[[Column], Column]) -> Column:
    """change(text), where ASCII text is only lower-cased and not sent to Python."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(plain, F.lower(text)), change(F.when(~plain, text)))


def fold(text: Column) -> Column:
    """NFKC, then Unicode case folding (ß to ss, ligatures apart)."""
    return _unless_ascii(text, _folded)


def casefold(text: Column) -> Column:
    return _unless_ascii(text, _casefolded)


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _letters(text: Column) -> Column:
    """Folded, without diacritics, alef and yeh forms unified; ASCII text has none of them."""
    return _unless_ascii(text, lambda t: F.translate(F.regexp_replace(_folded(t), DIACRITICS, ""), "أإآى", "اااي"))


def normalize_entity(text: Column) -> Column:
    """Entity key: folded, without diacritics, alef and yeh forms unified, white space collapsed."""
    return collapse(_letters(text))


def normalize_evidence(text: Column) -> Column:
    """As normalize_entity, but only the words, joined by single spaces."""
    return F.trim(F.regexp_replace(_letters(text), r"[^\p{L}\p{N}_]+", " "))


def normalize_transcript(text: Column) -> Column:
    """Search form of transcripts; lower case, not folded."""
    low = F.lower(text)
    spelt = F.translate(F.regexp_replace(F.translate(low, TATWEEL, ""), DIACRITICS, ""), "".join(SPELLING), "".join(SPELLING.values()))
    plain = F.when(low.rlike(ARABIC), spelt).otherwise(low)  # the spelling rules touch no other text, and cost most
    return collapse(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def transcript_tokens(text: Column) -> Column:
    """Distinct tokens of the normalised transcript; none for null or empty text."""
    return F.array_remove(F.array_distinct(F.split(F.coalesce(normalize_transcript(text), F.lit("")), " ")), "")


def query_terms(entity_key: Column) -> Column:
    """Words of an entity key, and a copy without the article of those longer than four letters."""
    words = F.array_distinct(tokens(entity_key))
    bare = F.transform(F.filter(words, lambda w: w.startswith("ال") & (F.length(w) > 4)), lambda w: F.substring(w, 3, 1 << 20))
    return F.array_sort(F.array_union(words, bare))


def words_among(entity_key: Column, terms: Column) -> Column:
    """Those of query_terms(entity_key) that are among terms; text without an article anywhere is split only."""
    return F.array_intersect(F.when(F.contains(entity_key, F.lit("ال")), query_terms(entity_key)).otherwise(tokens(entity_key)), terms)


def query_words(text: Column) -> Column:
    """Distinct words after case folding alone; diacritics split words."""
    return F.array_distinct(tokens(casefold(text)))


def light_stem(word: Column) -> Column:
    """Without the article, and without a final alef if more than three letters remain."""
    bare = F.regexp_replace(word, "^ال", "")
    return F.when((F.length(bare) > 3) & bare.endswith("ا"), F.regexp_replace(bare, "ا$", "")).otherwise(bare)


def stemmed(words: Column) -> Column:
    """Words joined by single spaces, each as light_stem makes it; where no alef stands, none changes."""
    return F.when(F.contains(words, F.lit("ا")), F.array_join(F.transform(F.split(words, " "), light_stem), " ")).otherwise(words)


def contains_phrase(transcript: Column, phrase: Column) -> Column:
    """Both normalised; a substring, not bound to tokens. An empty phrase matches nothing."""
    return (phrase != "") & F.contains(transcript, phrase)


def is_list_question(text: Column) -> Column:
    return text.rlike(LIST_QUESTION)


def citations(answer: Column, allowed: Column) -> Column:
    """Distinct S-numbers cited in any of three bracket styles, in order, of those allowed."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("S"), n))), lambda c: F.array_contains(allowed, c))


def in_order(text: Column, *parts: Column) -> Column:
    """Whether the parts occur in text one after another."""
    at, ok = F.lit(1), F.lit(True)
    for p in parts:
        place = F.call_function("locate", p, text, at)
        ok = ok & (place > 0)
        at = place + F.length(p)  # if it is not there, the answer is no wherever the others are
    return ok


def words_in_order(text: Column, *parts: Column) -> Column:
    """Whether the words of parts, joined by single spaces each, occur among those of text as runs, one after another."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    at, ok = F.lit(1), F.lit(True)
    for p in parts:
        place = F.call_function("locate", padded(p), padded(text), at)
        ok = ok & (place > 0)
        at = place + F.length(p) + 1  # the space after a run may begin the next
    return ok


def tokens_in_order(words: Column, *parts: Column) -> Column:
    """Whether the token arrays `parts` occur in `words` as runs, one after another; false if a part is empty.

    On space-padded strings the earliest run is the best one, so a chain of searches decides.
    """
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    at, ok = F.lit(1), F.lit(True)
    for p in parts:
        run = F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" "))
        place = F.call_function("locate", run, text, at)
        ok = ok & (F.size(p) > 0) & (place > 0)
        at = F.when(place > 0, place + F.length(run) - 1).otherwise(F.length(text) + 2)
    return ok


def fact_sentence(subject: Column, predicate: Column, object_: Column, evidence: Column) -> Column:
    return F.concat(subject, F.lit(" "), predicate, F.lit(" "), object_, F.lit(". "), evidence)


def fact_bullet(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" — ", subject, predicate, object_)
