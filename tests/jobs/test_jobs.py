"""Both jobs on copies of the test tables: reruns, growing input, failures between writes."""

import json
import os
import subprocess
import sys

import pytest

from jobs import ingest_segments, token_index
from jobs.common import settings

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def rows(df):
    return sorted(map(repr, df.collect()))


@needs_tables
def test_token_index_reruns(spark, tmp_path):
    out = f"{tmp_path}/index"
    first = token_index.run(spark, f"{FOLDER}/documents.parquet", out)
    before = rows(token_index.output(spark, out))
    assert token_index.run(spark, f"{FOLDER}/documents.parquet", out) == first
    assert rows(token_index.output(spark, out)) == before and len(before) == first["postings"] + first["vocabulary"] + first["videos"]


def test_token_index_of_awkward_rows(spark, tmp_path):
    docs = [(1, "The river, the stone", "a"), (1, "The river, the stone", "a"), (2, None, "b"), (3, "", None), (4, "the \n THE", None), (None, "nobody", "z")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    counts = token_index.run(spark, f"{tmp_path}/d", f"{tmp_path}/out", {"least_chunks": 2})
    assert counts["documents"] == 6
    got = {tuple(r) for r in token_index.output(spark, f"{tmp_path}/out").where("part <> 'postings' and token <> 'nobody'").collect()}
    assert got == {("vocabulary", "the", None, None, 2), ("vocabulary", "river", None, None, 1), ("vocabulary", "stone", None, None, 1), ("videos", "the", None, "a", 1), ("videos", "the", None, None, 1)}
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/none")
    assert token_index.run(spark, f"{tmp_path}/none", f"{tmp_path}/out") == {"documents": 0, "postings": 0, "vocabulary": 0, "videos": 0}


@needs_tables
def test_segments_take_only_what_is_new(spark, tmp_path):
    all_ = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    landing, out, mark = f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/mark"
    # some videos lie wholly in the first part, some in the second, some in both
    parts = [all_.where("conv_id % 3 = 0 or (conv_id % 3 = 1 and turn % 2 = 0)"), all_.where("conv_id % 3 = 2 or (conv_id % 3 = 1 and turn % 2 = 1)")]
    sizes = [p.count() for p in parts]
    parts[0].coalesce(1).write.mode("append").parquet(landing)
    assert ingest_segments.run(spark, landing, out, mark)["segments"] == sizes[0]
    parts[1].coalesce(1).write.mode("append").parquet(landing)
    assert ingest_segments.run(spark, landing, out, mark)["segments"] == sizes[1]
    assert ingest_segments.run(spark, landing, out, mark) == {"batches": 0, "segments": 0, "chunks": 0}
    ingest_segments.run(spark, f"{FOLDER}/conversations.parquet", f"{tmp_path}/once", f"{tmp_path}/mark-once")
    assert rows(ingest_segments.output(spark, out)) == rows(ingest_segments.output(spark, f"{tmp_path}/once"))


def test_a_batch_that_is_repeated_leaves_the_same(spark, tmp_path):
    schema = ingest_segments.CONVERSATIONS
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"
    spark.createDataFrame([(1, 0, "u", "one"), (1, 1, "u", "two"), (2, 0, "u", None), (None, 0, "u", "x"), (3, None, "u", "y"), (4, -1, "u", "z")], schema).coalesce(1).write.parquet(landing)
    ingest_segments.run(spark, landing, out, f"{tmp_path}/mark")
    spark.createDataFrame([(1, 1, "u", "two, anew"), (5, 2, "u", "late"), (5, 2, "u", "later")], schema).coalesce(1).write.mode("append").parquet(landing)
    ingest_segments.run(spark, landing, out, f"{tmp_path}/mark")
    before = rows(ingest_segments.output(spark, out))
    said = {r.chunk_id: r.transcript for r in ingest_segments.output(spark, out).collect()}
    assert said["1_chunk_0000"] == "one two, anew" and said["2_chunk_0000"] == "" and said["5_chunk_0001"] == "later" and not {c for c in said if c[0] in "34N"}
    # the last batch again, as after a driver that died before it was marked as done
    commits = sorted(p for p in os.listdir(f"{tmp_path}/mark/commits") if p.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/mark/commits/{name}"):
            os.remove(f"{tmp_path}/mark/commits/{name}")
    assert ingest_segments.run(spark, landing, out, f"{tmp_path}/mark")["segments"] == 3
    assert rows(ingest_segments.output(spark, out)) == before


def test_nothing_has_come_yet(spark, tmp_path):
    os.makedirs(f"{tmp_path}/landing")
    for _ in range(2):
        assert ingest_segments.run(spark, f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/mark") == {"batches": 0, "segments": 0, "chunks": 0}
        assert ingest_segments.output(spark, f"{tmp_path}/out").count() == 0


def test_settings(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"buckets": 3}))
    assert settings("ingest_segments", str(tmp_path / "own.json"))["buckets"] == 3
    (tmp_path / "bad.json").write_text(json.dumps({"bukets": 3}))
    with pytest.raises(ValueError):
        settings("ingest_segments", str(tmp_path / "bad.json"))


@needs_tables
def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    command = [sys.executable, "-m", "jobs.ingest_segments", "--segments", f"{FOLDER}/conversations.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    for expected in ("in 1 batches", "in 0 batches"):
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0 and expected in done.stderr, done.stderr[-2000:]
