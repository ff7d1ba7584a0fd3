import hashlib
import random

import numpy as np
import pytest

from kairoscope.llm import periodic


def plain(words):
    """(start, length, period) of all runs, by every period and place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if (n := j - i + q) >= max(12, 2 * q):
                found.setdefault((i, n), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def found(texts):
    word, edges = periodic.interned(texts)
    out = [[] for _ in texts]
    for d, *run in zip(*[x.tolist() for x in periodic.runs_of(word, edges)]):
        out[d].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_as_by_all_periods(seed):
    rng, texts = random.Random(seed), []
    for _ in range(12):
        n = rng.choice([0, 1, 2, 11, 12, 13, 40, 100, 200])
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        texts.append(words)
    assert found(texts) == [plain(t) for t in texts]


def test_fibonacci_words_hold_most_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1000:
        a, b = b, b + a
    assert found([b]) == [plain(b)] and len(found([b])[0]) > 200


def test_long_periodic_texts():
    n = 60_000
    for p in (1, 2, 1009):
        assert found([[b"%d" % (i % p) for i in range(n)]]) == [[(0, n, p)]]
    assert found([[b"a"] * 12, [b"a"] * 12]) == [[(0, 12, 1)]] * 2  # nothing across documents


def test_equal_numbers_of_three_words_decide_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda w: np.zeros(len(w), np.uint64))
    rng = random.Random(3)
    texts = [[b"%d" % rng.randrange(3) for _ in range(60)] for _ in range(5)]
    assert found(texts) == [plain(t) for t in texts]


def test_collapsed_and_digest(spark):
    text = "x y\t" + "a b c " * 5 + "\nend"
    df = spark.createDataFrame([(1, text, "own"), (2, None, "own"), (3, " \n", "own"), (4, "É é É é", "own")], "k int, text string, runs string")
    got = {r.k: r for r in periodic.find_runs(df, keep=["k", "runs"]).collect()}
    assert [tuple(x) for x in got[1].runs] == [(2, 15, 3)] and got[1].collapsed == "x y a b c end"
    assert [(got[k].runs, got[k].collapsed) for k in (2, 3, 4)] == [([], ""), ([], ""), ([], "É é É é")]
    out = periodic.find_runs(df, keep=["k"])
    row = out.where("k = 1").select(*[c.alias(n) for n, c in periodic.digest(out.runs, out.collapsed).items()]).first()
    assert tuple(row)[:5] == (1, 2, 15, 3, 5000) and row.runs_sha256 == hashlib.sha256(b"2,15,3\n").hexdigest()
