"""The model against plain sums over its whole vocabulary, and what it learns on texts that it has not seen."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kairoscope.llm import max_entropy as M

A, B = "the of and house river water light stone under".split(), "der und haus fluss wasser licht stein über mit".split()


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choice([A, B])
        out.append(" ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(words) + rng.choice("xyz") * rng.randint(1, 9) for _ in range(rng.choice([0, 5, 60]))))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(400, 1))], "k int, body string").repartition(3)
    return docs, M.train(docs, "body")


def plain_token(model, counts, before, word):
    """P(word | before) by the definition, one token at a time."""
    key = lambda w: zlib.crc32(w) if w in model.place else zlib.crc32(w[-3:], 1)
    one = key(before[-1]) if before else 0
    two = key(before[-2]) if len(before) > 1 else 0
    row = lambda bits, salt, *k: int(M._row(bits, salt, *[np.array([x], np.int64) for x in k])[0])
    c, s = model.place.get(word, (M.tail_class(word), None))
    z = model.bias.astype(float) + sum(model.shared[row(M.SHARED, *k)].astype(float) for k in ((1, one), (2, one, two), (3, two)))
    p = math.exp(z[c]) / np.exp(z).sum()
    if s is not None:
        z = model.inner_bias[c].astype(float) + sum(model.own[row(M.OWN, *k)].astype(float) for k in ((4, one, c), (5, two, c)))
        return p * math.exp(z[s]) / np.exp(z).sum()
    own = {w: n for w, n in counts.items() if w not in model.place and M.tail_class(w) == c}
    return p * (own.get(word, 0) + 1) / (sum(own.values()) + len(own) + 1)


def test_scores_counts_and_base_as_by_definition(spark, trained):
    docs, (model, table) = trained
    counts = Counter(w for t in texts(400, 1) for w in M.tokens(t))
    assert {r.word.encode(): r.n for r in table.collect()} == counts
    assert model.tokens == sum(counts.values()) and model.words == len(counts)
    fresh = [*texts(20, 2), None, "", "  ", "THE house of Ünseen", "  river", "x" * 9000, "stone " * 9000]
    got = M.score(spark.createDataFrame(list(enumerate(fresh)), "k int, text string"), (model, table), keep=["k"]).collect()
    assert len(got) == len(fresh)
    for r in got:
        words = M.tokens(fresh[r.k])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), model.tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (model.tokens + len(counts) + 1)) for w in words), rel=1e-9)
        if len(words) < 100:
            assert r.score == pytest.approx(sum(math.log10(plain_token(model, counts, words[:i], w)) for i, w in enumerate(words)), rel=1e-4)


def test_probabilities_sum_to_one(trained):
    _, (model, _) = trained
    counts = Counter(w for t in texts(400, 1) for w in M.tokens(t))
    unknown = {}
    for i in range(2000):
        w = b"unseen%d" % i
        unknown.setdefault(M.tail_class(w), w)
    assert len(unknown) == M.TAILS
    for before in ([], [b"the"], [b"fluss", b"und"], [b"never", b"met"]):
        assert sum(plain_token(model, counts, before, w) for w in [*counts, *unknown.values()]) == pytest.approx(1, abs=1e-5)


def test_held_out_texts_score_above_the_counts(spark, trained):
    fresh = spark.createDataFrame(list(enumerate(texts(100, 3))), "k int, text string")
    got = M.score(fresh, trained[1]).agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    gain = (got["sum(score)"] - got["sum(base_score)"]) / got["sum(n_tokens)"]
    assert gain > 0.1  # a third of what there is: of two vocabularies of one size, knowing which is worth log10(2) = 0.3


def test_gradient_is_that_of_the_likelihood(trained):
    _, (model, _) = trained
    words = M.Words(model)
    known, edges, _ = M._texts(texts(10, 4), words)
    total = np.zeros(((1 << M.SHARED) + (1 << M.OWN), M.WIDE + 1), np.float32)
    M.add_gradient(model, known, edges, total)
    for table, base in ((model.shared, 0), (model.own, 1 << M.SHARED)):
        r, c = divmod(int(np.abs(total[base : base + len(table), : table.shape[1]]).argmax()), table.shape[1])
        was, out = table[r, c], []
        for d in (0.05, -0.05):
            table[r, c] = was + d
            out.append(M.log_likelihood(model, known, edges).sum() * np.log(10))
        table[r, c] = was
        assert (out[0] - out[1]) / 0.1 == pytest.approx(total[base + r, c], rel=0.02)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "k int, text string")
    trained = M.train(docs)
    assert trained[0].tokens == 0
    got = M.score(spark.createDataFrame([(1, "a b", "own"), (2, None, "own")], "k int, text string, base string"), trained).orderBy("k").collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.base) for r in got] == [(3, 0, 0.0, "own"), (1, 0, 0.0, "own")]
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i % 50}" for i in range(k)),) for k in range(60)], "text string").coalesce(1)
    want = {r.word: r.n for r in M.count_words(docs).collect()}
    monkeypatch.setattr(M, "MOST_WORDS", 10)
    assert {r.word: r.n for r in M.count_words(docs).collect()} == want
