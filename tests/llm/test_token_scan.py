import random
import uuid

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kairoscope.llm import token_scan
from kairoscope.llm.bpe import load_ranks
from kairoscope.llm.queries import tokenizer

SETTINGS = (*tokenizer(), ())


def test_counts_of_written_streams(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma's", "<|endoftext|>", "é"]) for _ in range(rng.choice([0, 1, 5, 300])))) for i in range(200)] + [(None, "x y"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(tokenizer()[1]), special_tokens={})
    want = sorted((d is None, d or 0, len(enc.encode_ordinary(t or ""))) for d, t in rows)
    for block in (1, 7, 64, 1 << 16):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        token_scan.write_streams(docs, path, SETTINGS, block=block)
        got = token_scan.token_counts(spark, path).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want
        for s in {r.stream for r in got}:
            own = sorted((r.doc_no, r.start, r.n_tokens) for r in got if r.stream == s)
            at = 0
            for no, (n, start, size) in enumerate(own):
                assert (n, start) == (no, at)
                at += size + 1


def test_stitching_over_chunks_and_empty_blocks(spark):
    rng = random.Random(3)
    rows, want = [], []
    for stream in range(3):
        ids = [0 if rng.random() < 0.15 else 1 for _ in range(500)]
        cut, at = [0], 0
        while cut[-1] < 500:
            cut.append(min(500, cut[-1] + rng.choice([0, 1, 3, 20])))
        rows += [(stream, b, sum(1 for _ in range(lo, hi)), [i - lo for i in range(lo, hi) if not ids[i]]) for b, (lo, hi) in enumerate(zip(cut, cut[1:]))]
        no = 0
        for i, x in enumerate(ids):
            if not x:
                want.append((stream, no, at, i - at))
                no, at = no + 1, i + 1
    found = spark.createDataFrame(rows, "stream int, block bigint, length bigint, places array<int>")
    for chunk in (1, 4, 1000):
        assert sorted(tuple(r) for r in token_scan.stitched(found, chunk).collect()) == want


def test_ids_that_do_not_fit_are_refused():
    assert token_scan.narrowed(np.array([0, 65_535, 7]), 50_256).tolist() == [0, 65_535, 7]
    assert token_scan.narrowed(np.zeros(0, np.int64), 0).dtype == np.dtype("<u2")
    for ids in ([70_000], [65_536, 1], [-1], [5, 50_256]):
        with pytest.raises(ValueError):
            token_scan.narrowed(np.array(ids), 50_256)


def test_empty_table(spark, tmp_path):
    token_scan.write_streams(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", SETTINGS)
    assert token_scan.token_counts(spark, f"{tmp_path}/none").count() == 0
