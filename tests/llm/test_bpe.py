import random

import public_tokenizers
import pytest
import tiktoken

from kairoscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'s", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "b", "s", "t", "re", "1", "23", "!", "..", "é", "日本", "　", "\xa0", "'ll", "'LL", "'d", "x" * 70, "ab" * 200, "́", "😀", "\x1c", "\x85", "\x00", "²", "٣"]
TEXTS = [None, "", " ", "\n ", "'", "'s", " 's", "it's 'll!'re", "a" * 3000, " " * 3000 + "x", "word " * 2000, "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE(bpe.load_ranks(PATH))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_ids_match_the_library_and_decode_back(codec, reference):
    texts = TEXTS + fuzz(4000)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == reference.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()
        starts = codec.starts(ids)
        assert all(codec.token[i] == (text or "").encode()[s : s + len(codec.token[i])] for i, s in zip(ids, starts))


def test_every_code_point_is_classed_as_the_library_does(codec, reference):
    texts = [f"{c}a{c}1{c} !{c}" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    assert codec.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_batches_do_not_touch_each_other(codec):
    texts = ["a", " b", "'s", "", "  ", "\n", "c"]
    assert codec.split(texts) == [codec.split([t])[0] for t in texts]


def test_a_small_cache_gives_the_same(codec):
    small = bpe.ByteBPE(codec.ranks, most=5)
    for t in fuzz(300, 3):
        assert small.encode([t]) == codec.encode([t])


def test_long_and_short_merges_agree(codec):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeth on\xc3\xa9") for _ in range(rng.randrange(2, 64))) for _ in range(500)]
    assert codec._merge_all(pieces, 64) == [codec.merge_long(p) for p in pieces]


def test_scan_is_the_product_of_functions():
    import numpy as np

    rng = np.random.default_rng(1)
    stream = bpe.FUNCTIONS[rng.integers(0, 10, 5000)]
    state, want = 0, []
    for f in stream.tolist():
        state = int(bpe.PRODUCT[state, f])
        want.append(state)
    assert bpe.scan(stream, 16).tolist() == want


def test_tables(spark, codec, reference):
    import hashlib

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (0, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(found) == len(rows) and all(bytes(r.decoded) == (r.text or "").encode() and r.ids == reference.encode_ordinary(r.text or "") and len(r.offsets) == len(r.ids) for r in found)
    for r in bpe.round_trip(docs, PATH).collect():
        ids = reference.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
