import random

import zlib

import pytest
import xxhash

from kairoscope.llm import sharding


def placed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, serial int, range int")
    got = sharding.shard(sharding.keyed(docs, keep=docs.columns), **kw).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.serial, r.range) for r in got))) == sorted(map(repr, ((d, t, n, k) for d, t, _, n, k in rows)))
    return got


def well_formed(rows, got, shards=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1) for d, t, *_ in rows)
    sizes = [0] * shards
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        sizes[s] = sum(r.size for r in got if r.shard == s)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


@pytest.mark.parametrize("ranges", [None, 4])
def test_sizes_are_near_equal(spark, ranges):
    rng = random.Random(2)
    rows = [(i, rng.choice(["é", "x"]) * int(rng.paretovariate(1.1) * 20 % 3000), "s", 1, 2) for i in range(2000)]
    well_formed(rows, placed(spark, rows, ranges=ranges))


def test_copies_beyond_a_shard_are_split_and_small_groups_are_not(spark):
    rows = [(i, "copy " * 20, "s", 1, 2) for i in range(900)] + [(1000 + i, f"text {i // 3} " * 20, "s", 1, 2) for i in range(900)]
    got = placed(spark, rows)
    well_formed(rows, got)
    small = {}
    for r in got:
        if r.doc_id >= 1000:
            small.setdefault((r.doc_id - 1000) // 3, set()).add(r.shard)
    assert sum(len(s) > 1 for s in small.values()) <= 8


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None)] * 5 + [(3, None, "s", 1, 2)] * 4 + [(3, "", "s", 1, 2), (4, "a", None, 1, 2), (4, "a", None, 1, 2)]
    well_formed(rows, placed(spark, rows))
    assert placed(spark, []) == []
    assert [r.slot for r in placed(spark, [(1, "a", "s", 1, 1)])] == [0]


def test_placement_against_one_sorted_list(spark):
    """Whatever the splitters: shards are where the middles of the records lie in the order of (hash, id)."""
    rng = random.Random(4)
    texts = [None, "", *["w " * rng.randrange(1, 300) for _ in range(60)]]
    rows = [(i, rng.choice(texts), "s", i, 2) for i in range(700)]
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[1] is not None, signed(r[1]) if r[1] is not None else 0, r[0]))
    total, at, want, slots = sum(len((t or "").encode()) + 1 for _, t, *_ in rows), 0, {}, [0] * 8
    for d, t, *_ in order:
        size = len((t or "").encode()) + 1
        k = min(7, (2 * at + size) * 8 // (2 * total))
        want[d] = (size, zlib.crc32((t or "").encode()) if t is not None else 0, k, slots[k])
        slots[k] += 1
        at += size
    for ranges in (None, 3):
        assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in placed(spark, rows, ranges=ranges)} == want


def test_a_host_of_empty_texts_is_spread_over_ranges(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id < 15000, '', repeat('long text ', 500)) as text")
    seen = []
    whole = sharding.located
    monkeypatch.setattr(sharding, "located", lambda place, splitters, kind: seen.append(splitters) or whole(place, splitters, kind))
    got = sharding.shard(sharding.keyed(docs), ranges=16).collect()
    assert len(got) == 20_000
    empty = xxhash.xxh64_intdigest(b"", 42)
    empty -= 1 << 64 if empty >> 63 else 0
    cuts = [-1, *[k for h, k, _ in seen[-1] if h == empty], 15_000]
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= 2 * 2 * 20_000 / 16
