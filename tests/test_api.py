import json

import pytest
from pyspark.sql import functions as F

from kairoscope import __main__, api
from kairoscope.operators.graph import FACT, fact_key

CHUNK = "chunk_id string, chunk_index int, video_id string, start_timestamp double, end_timestamp double, transcript string, frame_path string, frame_sha256 string, source_filename string, video_path string, visual array<float>, audio array<float>"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(f"c{i}", i, "ab"[i % 2], 4.0 * i, 4.0 * i + 5, f"words about topic{i} and more", f"/x/{i}.jpg", f"h{i}", None, f"/v/{'ab'[i % 2]}.mp4", [1.0, float(i)], [float(i), 1.0] if i else None) for i in range(10)]
    facts = spark.createDataFrame([("a", "c0", 0.0, 5.0, "Ada", "wrote", "notes", "Ada wrote notes"), ("a", "c2", 8.0, 13.0, "Notes", "describe", "engine", "notes describe engine"), ("b", "c1", 4.0, 9.0, "Bob", "read", "papers", "Bob read papers")], "video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string")
    tables = api.build_graph(facts.withColumn("fact_key", fact_key(*[F.col(c) for c in FACT])))
    tables.pop("parents")
    return api.Engine(spark.createDataFrame(rows, CHUNK), lambda t: [1.0, 0.0], lambda t: [1.0, 0.0], **tables)


def test_search_modes(engine):
    assert engine.search("anything", 3).columns == ["start_timestamp", "end_timestamp", "confidence_score"] and engine.search("anything", 3).count() == 3
    assert [r.chunk_id for r in engine.preview("about topic7", 5).collect()] == ["c7"]
    assert {r.video_id for r in engine.preview("anything", 5, "a").collect()} == {"a"}
    assert engine.visual_preview("x", 2).first().chunk_id == "c0"
    assert engine.audio_preview("topic4 and more", 1).first().chunk_id == "c4"
    assert [engine.mode_of(q) for q in ("photo, please", "said", "topic3 and more", "unheard")] == [("visual", True), ("audio", True), ("audio", False), ("combined", False)]
    assert engine.auto_preview("photo", 2).count() == 2
    for bad in (0, 21):
        with pytest.raises(ValueError):
            engine.search("x", bad)


def test_responses(engine):
    got = engine.respond("about topic7", 5)
    assert [r["text_match"] for r in got["results"]] == [True] and got["total_chunks_searched"] == 10 and got["query_time_ms"] > 0
    assert set(got["results"][0]) == {"start_timestamp", "end_timestamp", "confidence_score", "video_id", "frame_url", "transcript_snippet", "text_match", "visual_similarity", "audio_similarity", "text_coverage"}
    assert [(r["visual_similarity"], r["audio_similarity"], r["text_coverage"]) for r in got["results"]] == [(None, None, 0.0)]
    heard, seen = (engine.respond("topic4 and more", 1, mode=m)["results"][0] for m in ("audio", "visual"))
    assert heard["text_coverage"] == 1.0 and heard["audio_similarity"] == pytest.approx(4 / 17**0.5) and heard["visual_similarity"] is None
    assert seen["visual_similarity"] == 1.0 and seen["audio_similarity"] is None and seen["text_coverage"] == 0.0
    auto = engine.respond("topic3 and more", 2, mode="auto")
    assert (auto["detected_intent"], auto["score_type"], auto["intent_reason"]) == ("audio", "audio_similarity", api.REASONS["audio", False])
    assert engine.respond("photo?", 2, mode="auto")["score_type"] == "visual_similarity"
    with pytest.raises(ValueError):
        engine.respond("x", mode="other")


def test_about(engine):
    assert engine.about() == {"modes": ["visual", "audio", "combined", "auto"], "visual_dimensions": 2, "audio_dimensions": 2, "graph_tables": ["edges", "entities", "members", "reports"], "ready": True}


def encoder(text):
    return [float(len(text)), 1.0]


def said(chunks):
    return [{"chunk_id": i, "subject": "river", "predicate": "of", "object": "stone", "evidence": "river of stone"} for i, _ in chunks]


def test_commands(spark, tmp_path, capsys):
    spark.createDataFrame([("v1", "a.mp4", 25.0, 300), ("v2", "b.mp4", 0.0, 10)], "video_id string, source_filename string, fps double, total_frames long").write.parquet(f"{tmp_path}/videos")
    spark.createDataFrame([("v1", 0, 0.0, 3.0, "hello there"), ("v1", 1, 5.0, 9.0, "the river of stone")], "video_id string, seg_idx int, start double, end double, text string").write.parquet(f"{tmp_path}/segments")
    spark.createDataFrame([("v1", "v1_chunk_0001", 4.0, 9.0, "river", "of", "stone", "the river of stone")], "video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string").write.parquet(f"{tmp_path}/facts")
    models = [f"--{m}={__name__}:encoder" for m in ("visual", "audio")]

    def run(*given):
        __main__.main([*given])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("ingest", f"--videos={tmp_path}/videos", f"--segments={tmp_path}/segments", f"--store={tmp_path}/store", *models) == {"videos": 1, "chunks": 3}
    assert run("index", f"--facts={tmp_path}/facts", f"--graph={tmp_path}/graph") == {"entities": 2, "facts": 1, "chunks": 1, "edges": 1, "levels": 1, "communities": 1}
    assert spark.read.parquet(f"{tmp_path}/graph/reports").first().member_count == 2
    assert run("migrate", f"--store={tmp_path}/store", f"--facts={tmp_path}/facts", f"--out={tmp_path}/out") == {"chunks": 3, "facts": 1}
    wanted = ["extract", f"--store={tmp_path}/store", f"--out={tmp_path}/found", f"--model={__name__}:said", "--model-id=m", "--prompt-hash=p"]
    assert run(*wanted) == {"inferred": 3} and run(*wanted) == {"cached": 3}
    assert spark.read.parquet(f"{tmp_path}/found/facts").count() == 2  # two windows say so
    got = run("ask", f"--store={tmp_path}/store", "--query=river of", *models)
    assert got["total_chunks_searched"] == 3 and all(r["text_match"] for r in got["results"])
    assert run("benchmark", f"--store={tmp_path}/store", "--query=river", "--query=hello", *models)["runs"] == 2


def test_graph_calls(engine):
    assert [r.chunk_id for r in engine.graph_preview("who is Ada", 5).collect()] == ["c0"]
    assert engine.list_entities().first().canonical_name == "Ada"
    assert engine.list_communities(0, "b").count() == 1 and engine.list_communities().count() >= 2
    assert sorted(r.filename for r in engine.videos().collect()) == ["a.mp4", "b.mp4"]


def test_answers(engine):
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    vectors = engine.entities.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    reports = engine.reports.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    got = engine.sources("Ada", "local", 3, embed=embed, entity_vectors=vectors).collect()
    assert len(got) == 3 and {r.citation_id for r in got} == {"S1", "S2", "S3"}
    whole = engine.sources("Ada", "global", 10, embed=embed, report_vectors=reports).collect()
    assert any(r.facts for r in whole)
    quoted = engine.graph_answer("Ada", top_k=3, embed=embed, entity_vectors=vectors)
    assert [c["citation_id"] for c in quoted["citations"]] == ["S1", "S2", "S3"] and quoted["answer"].startswith(api.UNCITED)
    assert len(quoted["matched_entities"]) == 5 and quoted["community_ids"] == [] and quoted["score_type"] == api.SCORE_TYPE
    made = engine.graph_answer("Ada", lambda q, s: "It is so [s 2].", top_k=3)
    assert (made["query"], made["mode"], made["answer"]) == ("Ada", "local", "It is so [s 2].")
    (cited,) = made["citations"]
    assert cited["citation_id"] == "S2" and set(cited) == {"citation_id", "chunk_id", "video_id", "start_timestamp", "end_timestamp", "frame_url", "evidence"}
    nothing = engine.graph_answer("Ada", video_id="none")
    assert nothing["sources"] == nothing["citations"] == [] and nothing["answer"] == api.NO_EVIDENCE
    # a video limits facts, communities and transcripts of global answers
    scoped = engine.graph_answer("Ada", mode="global", top_k=10, video_id="b", embed=embed, report_vectors=reports)
    assert {c["video_id"] for c in scoped["sources"]} == {"b"} and len(scoped["community_ids"]) >= 1
    members = {r.entity_key for r in engine.members.where(F.col("community_id").isin(scoped["community_ids"])).collect()}
    assert members == {"bob", "papers"}
    for bad in ({"mode": "other"}, {"top_k": 11}):
        with pytest.raises(ValueError):
            engine.sources("x", **bad)


def test_ingestion_status(engine):
    engine.begin("v")
    with pytest.raises(ValueError):
        engine.begin("v")
    engine.end("v")
    engine.begin("v")
    engine.end("v", "no audio")
    assert engine.status["v"] == "failed: no audio"
