import itertools
import random

import numpy as np

from kairoscope.llm import lang_id
from kairoscope.llm.common import Words, offsets
from kairoscope.llm.lang_id import words_of

WORDS = {"en": "the of and house river water light stone".split(), "de": "der und haus fluss wasser licht stein über".split(), "ru": "дом река вода свет камень и на".split(), "el": "σπίτι ποτάμι νερό φως πέτρα και".split()}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang) for lang in WORDS for _ in range(n)]


def best_path(scores, penalty):
    n, k = scores.shape
    return max(sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(k), repeat=n))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for trial in range(60):
        sizes = rng.integers(0, 7, 5)
        scores = rng.normal(0, 2, (sizes.sum(), 3)).astype(np.float32)
        edges = offsets(sizes)
        label = lang_id.viterbi(scores, edges, 1.5)
        for a, b in zip(edges, edges[1:]):
            if b > a:
                own = label[a:b]
                value = scores[np.arange(a, b), own].sum() - 1.5 * (np.diff(own) != 0).sum()
                assert abs(value - best_path(scores[a:b].astype(float), 1.5)) < 1e-4


def test_scripts_spans_and_defined_results():
    model = lang_id.Model.fit(corpus())
    table = words_of(model)
    text = "the river and the house of stone. река и дом на камень вода. the water and light"
    got = lang_id.identify([text, None, "", "123 !? 4", "漢字", "Haus und Wasser über Stein", "νερό"], model, table)
    assert [s["lang"] for s in got["spans"][0]] == ["en", "ru", "en"]
    assert [text[s["start"] : s["end"]].split()[0] for s in got["spans"][0]] == ["the", "река", "the"]
    assert got["lang_pred"][:4] == ["en", "und", "und", "und"] and got["score"][1:4] == [0, 0, 0]
    assert got["lang_pred"][4] in model.langs and got["score"][4] == 0
    assert got["lang_pred"][5:] == ["de", "el"] and all(0 <= s <= 1 for s in got["score"])


def test_a_bounded_word_table_gives_the_same():
    model = lang_id.Model.fit(corpus())
    texts = [t for t, _ in corpus(5, 9)]
    wide, narrow = words_of(model), Words(model.score, 5, most=3)
    for t in texts:
        assert lang_id.identify([t], model, wide) == lang_id.identify([t], model, narrow)


def test_held_out_accuracy_and_tables(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(corpus(60, 3))] + [(None, None, None, None), (5, "water", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = lang_id.train(docs.where("doc_id % 3 <> 1"), docs_per_lang=20)
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 1 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert lang_id.predict(docs.limit(0), model).count() == 0
    nothing = lang_id.predict(docs, lang_id.train(docs.limit(0)), spans=False).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_very_long_text():
    model = lang_id.Model.fit(corpus())
    text = "the river " * 30_000 + "дом река " * 30_000
    got = lang_id.identify([text, "x" * 200_000], model, words_of(model))
    assert [s["lang"] for s in got["spans"][0]] == ["en", "ru"]


def test_viterbi_with_over_256_languages():
    scores = np.zeros((12, lang_id.MOST_LANGUAGES), np.float32)
    scores[:6, 280] = scores[6:, 499] = 10
    assert lang_id.viterbi(scores, offsets([12]), 8.0).tolist() == [280] * 6 + [499] * 6


def test_one_language_is_known_and_sure(spark):
    texts = [t for t, lang in corpus(20, 5) if lang == "en"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(99, "дом река", None), (98, "12", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.predict(docs, lang_id.train(docs), spans=False).collect()}
    assert all(got[i].lang_pred == "en" and got[i].known == got[i].share == 1 and got[i].score > 0.99 for i in range(len(texts)))
    assert got[99].known == got[99].score == 0 and got[98].lang_pred == "und"


def test_three_hundred_languages():
    rng = random.Random(2)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(12)] for k in range(300)}
    texts = {lang: " ".join(rng.choice(own) for _ in range(60)) for lang, own in words.items()}
    model = lang_id.Model.fit([(" ".join(own), lang) for lang, own in words.items()])
    got = lang_id.identify([*texts.values(), f"{texts['l299']} {texts['l257']}"], model, words_of(model))
    assert got["lang_pred"][:300] == list(texts) and min(got["score"][:300]) > 0.9
    assert [s["lang"] for s in got["spans"][300]] == ["l299", "l257"]


def test_rare_labels_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(corpus(5))] + [(1000, "дом река", "ru"), (1001, "der Fluss", "de")], "doc_id long, text string, lang string")
    assert lang_id.train(docs).langs == ["de", "ru"]
