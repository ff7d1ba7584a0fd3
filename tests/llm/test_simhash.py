import random

import numpy as np
import xxhash

from kairoscope.llm import simhash


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, names, radius=3):
    """Brute force: smallest name reachable over pairs of at most `radius` bits."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(least.get(find(i), n), n)
    return [least[find(i)] for i in range(len(prints))]


TEXTS = ["A b c d", "a B c d", None, "", " \t\n\x0b\x0c\r", "one", "one two", "one two three", "Éa Éa éa", "x y z w\x1fv", "the cat " * 5000, "É" * 10, "\x00 a b"]


def test_fingerprints_match_the_definition():
    assert simhash.simhash(TEXTS).tolist() == [plain(t) for t in TEXTS]


def test_masks_cover_every_pair_within_the_radius():
    found = [m & (2**64 - 1) for m in simhash.masks()]
    assert len(found) == 15 and all(found)
    for i in range(64):
        for j in range(i, 64):
            for k in range(j, 64):
                differ = 1 << i | 1 << j | 1 << k
                assert any(not differ & m for m in found)


def test_forest_keeps_components():
    rng = random.Random(5)
    fps = {0}
    for _ in range(300):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 5, 9]))))
    fps = sorted(fps)
    got = {f: f for f in fps}
    signed = np.array(fps, np.uint64).view(np.int64)
    for children, roots in simhash.forest(signed, 3):
        for c, r in zip(children.tolist(), roots.tolist()):
            got[c % 2**64] = r % 2**64
    want = linked(fps, list(range(len(fps))))
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(got[f], set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = list(TEXTS)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        for _ in range(rng.choice([1, 3, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    rows = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts)] + [(2000, texts[-1], "y"), (2000, texts[-1], "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [plain(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], prints, linked(prints, [r[0] for r in rows])))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_blocks_of_a_large_bucket_lose_no_link(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)})
    edges = simhash.links(spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long"), block=16)
    roots = {r.a % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = linked(fps, fps)
    assert len({(roots.get(f, f), w) for f, w in zip(fps, want)}) == len(set(want)) == len({roots.get(f, f) for f in fps})


def test_components_with_and_without_hubs(spark):
    """Stars, paths and cliques; with keys of over 3 rows taken as hubs nothing changes."""
    edges = [(i, 0) for i in range(1, 60)] + [(101 + i, 100 + i) for i in range(40)] + [(a, b) for a in range(200, 212) for b in range(200, a)] + [(300, 59), (400, 130), (400, 205)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for hub in (None, 3):
        assert {r.a: r.root for r in simhash.components(df, hub=hub).collect()} == {x: r for x, r in label.items() if x != r}


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, None)], schema)).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in got) == [(False, False), (True, False), (True, True)]
