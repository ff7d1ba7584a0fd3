"""The incremental indexer: what is asked again, what is replaced, what stays."""

import os

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import graph, indexing
from kairoscope.sources import store

CHUNK = "video_id string, chunk_id string, start_timestamp double, end_timestamp double, transcript string, extra int"


def model(log):
    """Says of `a verb b` that a verb b, and things about chunks that it was not given, of blanks and of nulls."""

    def start():
        def ask(chunks):
            with open(log, "a") as f:
                f.writelines(f"{i}\n" for i, _ in chunks)
            out = [dict(zip(indexing.FACT, (i, *t.split()[:3], t.strip()))) for i, t in chunks if len(t.split()) >= 3]
            return out + out[:1] + [{"chunk_id": "other", "subject": "x", "predicate": "y", "object": "z", "evidence": "x y z"}, {"chunk_id": chunks[0][0], "subject": None}, {}]

        return ask

    return start


@pytest.fixture
def world(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "index")

    def run(rows, model_id="m1"):
        log.write_text("")
        how = indexing.index_videos(spark.createDataFrame(rows, CHUNK), path, model(str(log)), model_id, "p", 2)
        facts = {(r.video_id, r.chunk_id, r.subject, r.predicate, r.object) for r in indexing.table(spark, path, "facts").collect()}
        return {r.chunk_id: r.how for r in how.collect()}, facts, sorted(log.read_text().split())

    return run, path


def chunk(video, n, text):
    return (video, f"{video}{n}", n * 4.0, n * 4.0 + 5, text, n)


def test_only_what_is_new_is_asked(spark, world):
    run, path = world
    first = [chunk("v", 0, " ann met bob "), chunk("v", 1, "bob saw eve"), chunk("v", 2, "too short"), chunk("v", 3, "  \n"), chunk("v", 4, None), chunk("w", 0, "eve read books"), (None, "n", 0.0, 1.0, "a b c", 0), ("v", None, 0.0, 1.0, "a b c", 0)]
    how, facts, asked = run(first)
    assert how == {"v0": "inferred", "v1": "inferred", "v2": "inferred", "w0": "inferred"} and asked == ["v0", "v1", "v2", "w0"]
    assert facts == {("v", "v0", "ann", "met", "bob"), ("v", "v1", "bob", "saw", "eve"), ("w", "w0", "eve", "read", "books")}
    assert run(first) == ({c: "cached" for c in how}, facts, [])  # again: nothing is asked, the tables stay
    changed = [chunk("v", 0, "ann met bob"), chunk("v", 1, "bob saw tom"), chunk("v", 2, "too short")]
    how, facts, asked = run(changed)
    assert how == {"v0": "cached", "v1": "inferred", "v2": "cached"} and asked == ["v1"]
    assert facts == {("v", "v0", "ann", "met", "bob"), ("v", "v1", "bob", "saw", "tom"), ("w", "w0", "eve", "read", "books")}
    how, facts, asked = run(changed, "m2")
    assert set(how.values()) == {"inferred"} and len(asked) == 3  # another model starts anew
    assert run(changed, "m1")[2] == asked  # and so does the first one, whose entries were replaced


def test_facts_outlive_a_lost_cache(spark, world):
    run, path = world
    rows = [chunk("v", 0, "ann met bob"), chunk("v", 1, "nothing")]
    _, facts, _ = run(rows)
    indexing.remove(spark, f"{path}/cache")
    assert run(rows) == ({"v0": "stored", "v1": "stored"}, facts, [])
    assert run(rows) == ({"v0": "cached", "v1": "cached"}, facts, [])


def test_a_video_without_facts_left_and_one_without_speech(spark, world):
    run, _ = world
    run([chunk("v", 0, "ann met bob"), chunk("w", 0, "eve read books")])
    assert run([chunk("v", 0, "silence")])[1] == {("w", "w0", "eve", "read", "books")}
    assert run([chunk("w", 0, " ")]) == ({}, {("w", "w0", "eve", "read", "books")}, [])
    assert run([]) == ({}, {("w", "w0", "eve", "read", "books")}, [])


def test_repeated_chunks_count_once(spark, world):
    run, _ = world
    how, facts, asked = run([chunk("v", 0, "ann met bob")] * 3 + [chunk("v", 0, "zoe met bob")])
    assert asked == ["v0"] and facts == {("v", "v0", "ann", "met", "bob")}


def test_a_run_leaves_no_scratch_table_but_its_answer(spark, tmp_path):
    chunks = spark.createDataFrame([("v", f"c{i}", float(i), i + 1.0, "Ann likes tea") for i in range(3)], "video_id string, chunk_id string, start_timestamp double, end_timestamp double, transcript string")
    before = set(os.listdir(store.shared_folder(spark)))
    how = indexing.index_videos(chunks, str(tmp_path), lambda: lambda asked: [dict(zip(graph.FACT, (c, "Ann", "likes", "tea", "Ann likes tea"))) for c, _ in asked], "m", "p")
    assert {r.how for r in how.collect()} == {"inferred"} and indexing.table(spark, str(tmp_path), "facts").count() == 3
    left = set(os.listdir(store.shared_folder(spark))) - before
    assert not [x for x in left if x.split("-")[0] in ("spoken", "found", "candidates", "after")]


def test_facts_are_made_where_their_chunk_lies_and_no_task_has_a_video_to_itself(spark, monkeypatch):
    rows = [("v", f"c{i}", float(i % 7), 1.0, "الحب ذا ann; ann met bob", "h", [dict(zip(graph.FACT, ("x", s, "met", o, "ann met bob "))) for s, o in (("ann", "bob"), (" ann", "bob"), ("bob", "ann"), ("", "bob"))], "cached") for i in range(30)]
    chunks = spark.createDataFrame(rows, "video_id string, chunk_id string, start_timestamp double, end_timestamp double, transcript string, transcript_hash string, candidates array<struct<chunk_id:string,subject:string,predicate:string,object:string,evidence:string>>, how string")
    found = indexing.facts_of(chunks)
    assert sorted((r.chunk_id, r.subject, r.object) for r in found.collect()) == sorted((r[1], "ann", "bob") for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plans, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more))
    got = {r.chunk_id: r.batch for r in graph.batches(chunks.select("video_id", "chunk_id", "start_timestamp"), 4).collect()}
    order = sorted((r[2], r[1]) for r in rows)
    assert got == {c: i // 4 for i, (_, c) in enumerate(order)}
    assert "rangepartitioning" in plans[0] and "Window" not in plans[0]
