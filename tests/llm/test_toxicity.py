import random

import numpy as np

from kairoscope.llm import toxicity
from kairoscope.llm.common import LETTERS, Words

PLAIN = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ren", "sto", "mil", "ta") for c in ("da", "ne", "or")]
BAD = ["idiotic", "moronic", "trashy", "worthless"]


def sample(n, seed, bad=BAD):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 400))]
        if i % 5 == 0:
            for _ in range(max(1, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_held_out_and_misspelt_words():
    train = sample(600, 1)
    model = toxicity.Model.fit([t for _, t, _ in train], [y for _, _, y in train])
    table = Words(model.word_gaps, 1)
    for bad in (BAD, ["idiotics", "morronic", "trashyy", "worthlesss"]):
        test = sample(200, 2, bad)
        right = (model.scores([t for _, t, _ in test], table) >= 0.5) == np.array([y for _, _, y in test], bool)
        assert right.mean() >= 0.95


def test_one_bad_passage_in_a_long_text_shows():
    train = sample(600, 1)
    model = toxicity.Model.fit([t for _, t, _ in train], [y for _, _, y in train])
    clean = " ".join(random.Random(5).choice(PLAIN) for _ in range(5000))
    bad = clean[: len(clean) // 2] + " " + " ".join(["idiotic moronic", *PLAIN[:20]] * 8) + " " + clean[len(clean) // 2 :]
    score = model.scores([clean, bad], Words(model.word_gaps, 1))
    assert score[0] < 0.5 <= score[1]


def test_windows_cover_all_words_and_none_is_short():
    for n in (0, 1, 191, 192, 193, 383, 384, 1000):
        edges = toxicity.windows(n)
        assert edges[0] == 0 and edges[-1] == n and (len(edges) == 2 or np.diff(edges).min() >= toxicity.WINDOW)


def test_tables(spark):
    rows = sample(200, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "ba", None), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, 1), (901, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.predict(docs, model).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    empty = toxicity.predict(docs.limit(0), model)
    assert empty.count() == 0
    assert {r.score < 0.01 for r in toxicity.predict(docs, toxicity.train(docs, labels.limit(0))).collect()} == {True}


def plain_score(model, text):
    """Word by word and n-gram by n-gram, in whole numbers modulo 2^64."""
    gaps = []
    for word in LETTERS.findall((text or "").lower()):
        marked, own = f"<{word}>", []
        for low in range(len(marked)):
            h = 0
            for n, c in enumerate(marked[low : low + model.HIGH], 1):
                h = (h * 1_000_003 + ord(c) + n) % 2**64
                if n >= model.LOW:
                    own.append(float(model.gaps[h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - model.BITS]))
        gaps.append(sum(own) / max(1, len(own)))
    count = max(1, len(gaps) // toxicity.WINDOW)
    best = -np.inf
    for k in range(count):
        part = gaps[k * toxicity.WINDOW : (k + 1) * toxicity.WINDOW if k + 1 < count else None]
        best = max(best, sum(part) / max(1, len(part)) + model.bias)
    return 1 / (1 + np.exp(-best))


def test_scores_match_a_plain_scorer():
    train = sample(300, 6)
    model = toxicity.Model.fit([t for _, t, _ in train], [y for _, _, y in train])
    texts = [None, "", "12 !", "a", "İstanbul Straße été", *[t for _, t, _ in sample(30, 7)], " ".join(t for _, t, _ in sample(12, 8))]
    got = model.scores(texts, Words(model.word_gaps, 1))
    assert np.abs(got - [plain_score(model, t) for t in texts]).max() < 1e-5


def test_labels_without_a_text_do_not_use_up_the_sample(spark):
    rows = sample(120, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    got = toxicity.train(docs, labels, positives=24, negatives=96)
    want = toxicity.train(docs, labels.where("doc_id < 10000"), positives=24, negatives=96)
    assert got.bias == want.bias and (got.gaps == want.gaps).all() and np.abs(got.gaps).max() > 0
