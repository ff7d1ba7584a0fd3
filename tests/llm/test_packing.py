import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kairoscope.llm import packing
from kairoscope.llm.queries import tokenizer


def least_bins(sizes, capacity):
    """Exact, for a few items."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for b in sorted({r for r in rooms if r >= sizes[i]}):
            k = rooms.index(b)
            go(i + 1, rooms[:k] + [b - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bound_and_packing_enclose_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        sizes = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))])
        bins = packing.best_fit_decreasing(sizes, 20)
        assert max(np.bincount(bins, sizes)) <= 20
        exact = least_bins(sizes.tolist(), 20)
        assert packing.lower_bound(sizes, 20) <= exact <= bins.max() + 1
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3  # beyond the sum's bound of 2


def check(rows, got, capacity=2048):
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        own = [*ids.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(own) % capacity or capacity
        for k, low in enumerate([0, *range(first, len(own), capacity)]):
            piece = own[low : first if k == 0 else low + capacity]
            want.append((d is None, d or 0, k, low, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def sample():
    rng = random.Random(5)
    words = ["river", "stone's", "light", " ", "\n", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.9) * 30) % 4000))) for i in range(400)]
    return rows + [(None, "x"), (None, None), (3, ""), (3, ""), (9, "<|endoftext|> a"), (10, " " * 60_000), (11, " " * 1_000_000 + "x")]


def test_pieces_and_sequences(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.pieces(docs, tokenizer())
    one = check(rows, packing.pack(cut).collect())
    many = packing.pack(cut.withColumn("part", cut.length * 0), part_rows=40).collect()
    n = check(rows, many)
    total = sum(r.length for r in many)
    assert -(-total // 2048) <= one <= n <= one + 12
    assert all(r.bins >= r.bound for r in many)


def test_gap_partitions_exchange(spark):
    rng = random.Random(2)
    cut = spark.createDataFrame([(i, rng.randrange(350, 720)) for i in range(600)], "doc_id long, length bigint")
    alone = packing.pack(cut, part_rows=20, rounds=0).select("sequence_id").distinct().count()
    pooled = packing.pack(cut, part_rows=20, rounds=3).collect()
    used = {}
    for r in pooled:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.doc_id for r in pooled) == list(range(600)) and len(used) < alone
    for own in used.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_other_errors_are_not_taken_for_a_long_run():
    encode = packing.Encoder(*tokenizer())

    class Broken:
        def encode_to_numpy(self, *_, **__):
            raise KeyboardInterrupt

    encode.fast = Broken()
    with pytest.raises(KeyboardInterrupt):
        encode("a")


def test_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), tokenizer())).count() == 0
