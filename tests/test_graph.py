import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import communities, graph, mentions
from kairoscope.sources import media, store
from kairoscope.streaming import segments as streaming

FACT = "video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string"


def facts(spark, rows):
    df = spark.createDataFrame(rows, FACT)
    return graph.keyed_facts(df.withColumn("fact_key", graph.fact_key(*[F.col(c) for c in graph.FACT])))


def test_entities_and_edges(spark):
    found = facts(spark, [("v", "c1", 8.0, 9.0, "Café", "has", "x", "e"), ("v", "c0", 4.0, 5.0, "café", "has", "y", "e"), ("v", "c2", 9.0, 9.0, "a", "Likes", "b", "e"), ("v", "c2", 9.0, 9.0, "a", "likes", "b", "e"), ("v", "c3", 9.0, 9.0, " ", "likes", "b", "e")])
    names = {r.entity_key: r for r in graph.resolved_entities(found).collect()}
    assert names["café"].canonical_name == "café" and names["café"].aliases == ["Café", "café"] and "" not in names
    edges = graph.fact_edges(found).collect()
    assert len(edges) == 3 and sum(e.subject_key == "a" for e in edges) == 1


def test_weights_add_both_directions_and_leave_loops(spark):
    rows = [("v", f"c{i}", 0.0, 1.0, s, "p", o, "e") for i, (s, o) in enumerate([("a", "b")] * 2 + [("b", "a")] * 3 + [("a", "a")])]
    assert [(r.a, r.b, r.weight) for r in graph.edge_weights(graph.fact_edges(facts(spark, rows))).collect()] == [("a", "b", 5)]


def test_one_hop_takes_the_earliest(spark):
    rows = [("v", f"c{i:02d}", float(20 - i), 30.0, "hub", "p", f"n{i}", "e") for i in range(20)] + [("v", "x", 0.0, 1.0, "p", "q", "r", "e")]
    edges = graph.fact_edges(facts(spark, rows))
    near = graph.one_hop(edges, spark.createDataFrame([("hub",)], "entity_key string"), 3)
    assert sorted(r.start_timestamp for r in near.collect()) == [float(i) for i in range(1, 19)]
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()


def test_validation(spark):
    chunks = spark.createDataFrame([("c", "We saw that A uses B today. Then b. Also الذاتي يتعلم"), ("r", "B uses A; A uses B")], "chunk_id string, transcript string")
    rows = [("c", "A", "uses", "B", "A uses B"), ("c", "B", "uses", "A", "A uses B"), ("c", "A", "uses", "B", "A never uses B"), ("c", "uses", "A", "B", "a uses b"), ("x", "A", "uses", "B", "A uses B"), ("c", "A", "", "B", "A uses B"), ("r", "A", "uses", "B", "B uses A; A uses B")]
    got = graph.validated(spark.createDataFrame(rows, "chunk_id string, subject string, predicate string, object string, evidence string"), chunks).collect()
    assert sorted((r.subject, r.evidence) for r in got) == [("A", "A uses B"), ("uses", "a uses b")]


def test_routing_batches_and_json(spark):
    chunks = spark.createDataFrame([("v", f"c{i}", float(i)) for i in range(7)], "video_id string, chunk_id string, start_timestamp double")
    found = spark.createDataFrame([("c1", "a", "b", "c", "e"), ("zz", "a", "b", "c", "e")], "chunk_id string, subject string, predicate string, object string, evidence string")
    assert {r.chunk_id: len(r.candidates) for r in graph.routed_candidates(chunks, found).collect()} == {f"c{i}": int(i == 1) for i in range(7)}
    assert [r.batch for r in graph.batches(chunks, 3).orderBy("start_timestamp").collect()] == [0, 0, 0, 1, 1, 1, 2]
    texts = spark.createDataFrame([(json.dumps([{"subject": "a"}]),), ("{}",), ("no",), ("[]",)], "j string").select(graph.decoded_candidates(F.col("j")).alias("x")).collect()
    assert [None if r.x is None else len(r.x) for r in texts] == [1, None, None, 0]


def cliques():
    edges, nodes = [], []
    for g in range(4):
        own = [f"g{g}n{i}" for i in range(5)]
        nodes += own
        edges += [(a, b, 3) for i, a in enumerate(own) for b in own[i + 1 :]]
    edges += [("g0n0", "g1n0", 1), ("g2n0", "g3n0", 1), ("g1n1", "g2n1", 1)]
    return edges, [*nodes, "alone"]


def invariants(spark, levels, weights, nodes):
    rows = levels.collect()
    by = {}
    for r in rows:
        by.setdefault(r.level, {})[r.entity_key] = r.community
    last = -1.0
    for level in sorted(by):
        assert set(by[level]) == set(nodes) and by[level]["alone"] == "alone"
        if level:
            below = {}
            for n, c in by[level - 1].items():
                below.setdefault(c, set()).add(by[level][n])
            assert all(len(x) == 1 for x in below.values())
        q = communities.modularity(weights, levels.where(F.col("level") == level)).first()[0]
        assert q >= last - 1e-12
        last = q
    return by, last


def test_communities_of_cliques(spark):
    edges, nodes = cliques()
    weights = spark.createDataFrame(edges, "a string, b string, weight long")
    names = spark.createDataFrame([(n,) for n in nodes], "entity_key string")
    levels = communities.detect(weights, names).persist()
    by, best = invariants(spark, levels, weights, nodes)
    assert best > 0.6
    assert {frozenset(n for n in nodes if by[0][n] == c) for c in by[0].values()} == {frozenset(n for n in nodes if n.startswith(f"g{g}")) for g in range(4)} | {frozenset(["alone"])}


@pytest.mark.parametrize("seed", range(3))
def test_communities_do_not_depend_on_where_they_are_solved(spark, seed):
    """One task and distributed moves give the same levels."""
    rng = random.Random(seed)
    nodes = [f"é{i}" if i % 9 == 0 else f"n{i}" for i in range(60)]
    edges = [(a, b, rng.randrange(1, 5)) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j and rng.random() < (0.5 if i % 5 == j % 5 else 0.04)]
    weights = spark.createDataFrame([(*sorted(e[:2]), e[2]) for e in edges], "a string, b string, weight long")
    names = spark.createDataFrame([(n,) for n in [*nodes, "alone"]], "entity_key string")
    one = communities.detect(weights, names).persist()
    assert sorted(map(tuple, communities.detect(weights, names, small=3).collect())) == sorted(map(tuple, one.collect()))
    invariants(spark, one, weights, [*nodes, "alone"])


def test_levels_begun_by_moves_end_in_one_task(spark):
    """Whether one task takes over after any round makes no difference."""
    rng = random.Random(7)
    edges = [(f"n{i:03}", f"n{j:03}", 1 + (i % 3)) for i in range(48) for j in range(i + 1, 48) if rng.random() < (0.9 if i // 6 == j // 6 else 0.2 if i // 24 == j // 24 else 0.02)]
    weights = spark.createDataFrame(edges, "a string, b string, weight long")
    names = weights.select(F.explode(F.array("a", "b")).alias("entity_key")).distinct()
    want = sorted(map(tuple, communities.detect(weights, names).collect()))
    assert max(k for k, *_ in want) > 0
    assert sorted(map(tuple, communities.detect(weights, names, small=len(edges) - 1).collect())) == want


def test_edges_stay_where_they_lie_in_a_move(spark):
    both = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (1, 2, 1), (2, 1, 1)], "n long, m long, w long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "n long, name string")
    edges, nodes, total, several = communities._laid_out(both, both.where("false").select("n", "w"), names)
    label = spark.createDataFrame([(0, 0, 2), (1, 1, 3), (2, 2, 1)], "n long, c long, mass long")
    moved = communities._move(edges, nodes, label, total, 0, several)
    assert total == 6 and not several
    assert {r.n: (r.home, r.to, r.near) for r in moved.collect()} == {0: (0, 1, 0), 1: (1, 0, 0), 2: (2, 1, 0)}
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(map(tuple, communities._move(edges, nodes, label, total, 0, True).collect())) == sorted(map(tuple, moved.collect()))


def test_a_move_writes_and_shuffles_nothing(spark, monkeypatch):
    """Edges are packed once a round; where labels are too many to be sent, edges meet them by shuffles, with the same levels."""
    edges = [(f"n{i:02}", f"n{j:02}", 1 + i % 2) for i in range(30) for j in range(i, 30) if i // 6 == j // 6 or (i * j) % 11 == 1]
    weights = spark.createDataFrame(edges, "a string, b string, weight long")  # with loops
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(31)], "entity_key string")
    written, plain = [], communities.materialize
    monkeypatch.setattr(communities, "materialize", lambda df, name, *more: written.append(name) or plain(df, name, *more))
    got = sorted(map(tuple, communities.detect(weights, nodes, small=3).collect()))
    assert not {"label", "mass", "degree"} & set(written) and written.count("communities") >= 1
    assert got == sorted(map(tuple, communities.detect(weights, nodes).collect()))
    monkeypatch.setattr(communities, "SENT_NODES", 5)
    assert got == sorted(map(tuple, communities.detect(weights, nodes, small=3).collect())) and "label" in written


def test_modularities_of_all_levels_at_once(spark):
    edges, nodes = cliques()
    weights = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a string, b string, weight long")
    levels = communities.detect(weights, weights.select(F.explode(F.array("a", "b")).alias("entity_key")).distinct()).persist()
    alone = levels.where("level = 0").withColumn("community", F.col("entity_key"))
    each = [alone, *[levels.where(F.col("level") == k) for k in range(levels.agg(F.max("level")).first()[0] + 1)]]
    assert communities.modularities(weights, levels) == pytest.approx([communities.modularity(weights, x).first()[0] for x in each])
    assert communities.modularities(weights.where("false"), levels) == communities.modularities(weights, levels.where("false")) == []


def test_no_edges_gives_one_level_of_singletons(spark):
    weights = spark.createDataFrame([], "a string, b string, weight long")
    got = communities.detect(weights, spark.createDataFrame([("a",), ("b",), ("c",)], "entity_key string")).collect()
    assert sorted((r.level, r.entity_key, r.community) for r in got) == [(0, x, x) for x in "abc"]


def quality(edges, of):
    total = 2 * sum(w for *_, w in edges) or 1
    mass = {}
    for a, b, w in edges:
        for x in (a, b):
            mass[of[x]] = mass.get(of[x], 0) + w
    return sum(2 * w for a, b, w in edges if of[a] == of[b]) / total - sum((m / total) ** 2 for m in mass.values())


def in_turn(edges, nodes):
    """Plain local moving: one node after the other to its best neighbour community until none gains."""
    of, moved = {n: n for n in nodes}, True
    while moved:
        moved = False
        for n in nodes:
            best = max(sorted({of[n], *[of[b if a == n else a] for a, b, _ in edges if n in (a, b)]}), key=lambda c: quality(edges, of | {n: c}))
            if quality(edges, of | {n: best}) > quality(edges, of) + 1e-12:
                of[n], moved = best, True
    return of


def test_levels_never_lose_modularity_and_are_about_as_good_as_moves_in_turn():
    rng = random.Random(2)
    for _ in range(12):
        nodes = [f"n{i:02}" for i in range(24)]
        edges = [(a, b, rng.randrange(1, 4)) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j and rng.random() < (0.6 if i % 4 == j % 4 else 0.08)]
        levels = communities.solved(edges, nodes)
        values = [quality(edges, {n: n for n in nodes}), *[quality(edges, x) for x in levels]]
        assert values == sorted(values)
        assert values[-1] >= 0.9 * quality(edges, in_turn(edges, nodes))


def test_titles_take_the_first_names_and_count_all(spark):
    members = spark.createDataFrame([("L0-x", 0, f"k{i}") for i in range(30)], "community_id string, level int, entity_key string")
    entities = spark.createDataFrame([(f"k{i}", f"Name {i:02}") for i in range(30)], "entity_key string, canonical_name string")
    edges = facts(spark, [("v", f"c{i}", float(i), i + 1.0, f"k{i}", "p", f"k{i + 1}", "e") for i in range(5)])
    named = graph.named_edges(graph.fact_edges(edges), entities)
    (got,) = communities.reports(members, named, entities, most_facts=3).collect()
    assert got.member_count == 30 and got.report.split("\n")[0] == "، ".join(f"Name {i:02}" for i in range(6)) and len(got.report.split("\n")) == 4 and got.videos == ["v"]


def test_mentions(spark):
    rows = [("v", "c1", 1.0, "Apple Pie", "X"), ("v", "c1", 1.0, "Tea", "X"), ("v", "c1", 1.0, "Tea", "X"), ("v", "c2", 2.0, "tea", "X"), ("v", "c2", 2.0, "Jam", "X"), ("v", "c3", 3.0, "Jam", "X")]
    df = spark.createDataFrame(rows, "video_id string, chunk_id string, start_timestamp double, name string, entity_type string")
    assert sorted(map(tuple, mentions.co_mentions(df).collect())) == [("c1", "Apple Pie", "Tea"), ("c2", "Jam", "tea")]
    found = mentions.search(df, F.array(F.lit("tea"), F.lit("apple")), 5).collect()
    assert [(r.chunk_id, r.score) for r in found] == [("c1", 3), ("c2", 3)]
    assert {r.name_key: r.display_name for r in mentions.entities(df).collect()}["tea"] in ("Tea", "tea")


def test_store(spark, tmp_path):
    at = store.ChunkStore(spark, f"{tmp_path}/store")
    rows = spark.createDataFrame([("a", "a1", 0, "x"), ("a", "a2", 1, "y"), ("b", "b1", 0, "z")], "video_id string, chunk_id string, chunk_index int, transcript string")
    at.replace(rows)
    at.replace(rows.where("chunk_id = 'a1'"))
    assert sorted(r.chunk_id for r in at.read().collect()) == ["a1", "b1"]
    assert at.delete("b") == 1 and [r.chunk_id for r in at.read().collect()] == ["a1"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, store.upserted(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_uploads_and_models(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for name, content in (("b.MP4", b"1"), ("a.mp4", b"1"), ("c.txt", b"2"), ("d.webm", b"3")):
        (tmp_path / "up" / name).write_bytes(content)
    got = sorted(r.source_filename for r in media.uploads(media.files(spark, f"{tmp_path}/up")).collect())
    assert got == ["a.mp4", "d.webm"]
    df = spark.createDataFrame([("c1", "ab"), ("c2", None)], "chunk_id string, transcript string")
    vec = media.embedded(df, "transcript", "v", lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()
    assert [r.v for r in vec] == [[2.0, 0.0], [0.0, 0.0]]
    chunks = spark.createDataFrame([(v, f"{v}{i}", float(i), f"t{i}") for v in "ab" for i in range(7)], "video_id string, chunk_id string, start_timestamp double, transcript string")
    calls = media.extracted(chunks, lambda: lambda rows: [{"chunk_id": rows[0][0], "subject": ",".join(c for c, _ in rows), "evidence": rows[-1][1]}], 3).collect()
    assert sorted((r.chunk_id, r.subject, r.evidence, r.object) for r in calls) == sorted((f"{v}{i}", ",".join(f"{v}{j}" for j in range(i, min(7, i + 3))), f"t{min(6, i + 2)}", None) for v in "ab" for i in (0, 3, 6))


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.range(60).selectExpr("id % 50 as event_id", "timestamp_seconds(id * 60) as ts", "id % 3 as user_id", "'a' as event_type", "1.0D as value")
    rows.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    done = streaming.sliding_counts(stream, late="2 hours").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    done.awaitTermination(120)
    want = sorted(map(tuple, streaming.sliding_counts(rows).collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == want
    keep = streaming.first_seen(stream, late="2 hours").writeStream.foreachBatch(streaming.upsert_into(f"{tmp_path}/out", ["event_id"], ["ts"], buckets=4)).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    keep.awaitTermination(120)
    assert streaming.latest(spark, f"{tmp_path}/out", rows.schema).count() == 50


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_upserts_by_batch(spark, tmp_path, mode):
    """The last row of a key wins, a repeated batch changes nothing, buckets that a batch does not touch stay, versions are few."""
    was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        _upserts(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", was)


def _upserts(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, n long, v string"
    apply = streaming.upsert_into(path, ["k"], ["n"], buckets=3)
    rng, want = random.Random(1), {}
    assert streaming.latest(spark, path, spark.createDataFrame([], schema).schema).count() == 0
    batches = [[(rng.randrange(12), 100 * b + i, f"{b}.{i}") for i in range(rng.choice([0, 1, 2, 30]))] for b in range(7)]
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        for _ in range(1 + b % 2):
            apply(df, b)
        want |= {k: (k, n, v) for k, n, v in rows}
        assert sorted(map(tuple, streaming.latest(spark, path, df.schema).collect())) == sorted(want.values())
    # half a version, as a batch leaves it that dies while it writes, is not read
    spark.createDataFrame([(k, 10**9, "half") for k in range(12)], schema).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/v=99")
    for name in ("_SUCCESS", "._SUCCESS.crc"):
        os.remove(f"{path}/v=99/{name}")
    assert sorted(map(tuple, streaming.latest(spark, path, df.schema).collect())) == sorted(want.values())
    kept = {}
    for v, b in streaming._versions(spark, path):
        kept.setdefault(b, []).append(v)
    assert max(map(len, kept.values())) <= 2


def test_videos_of_any_name_are_replaced_and_deleted(spark, tmp_path):
    at = store.ChunkStore(spark, f"{tmp_path}/store")
    names = ["a:b", "50%", "a/b", "plain", "007", "x=y", "é漢"]
    at.replace(spark.createDataFrame([(v, f"c{i}", i, "x") for i, v in enumerate(names)] * 2, "video_id string, chunk_id string, chunk_index int, transcript string"))
    left = set(names)
    for v in names:
        assert {r.video_id for r in at.read().collect()} == left
        if len(left) > 1:
            assert at.delete(v) == 2
            left.remove(v)
    numbers = store.ChunkStore(spark, f"{tmp_path}/numbers")
    numbers.replace(spark.createDataFrame([("007", "c", 0), ("08", "d", 1)], "video_id string, chunk_id string, chunk_index int"))
    assert sorted(r.video_id for r in numbers.read().collect()) == ["007", "08"] and numbers.delete("007") == 1


def test_point_ids_and_fact_keys(spark):
    import hashlib
    import uuid

    names = ["v_chunk_0001", "", "é漢 \"quoted\" \\ \n"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(store.point_id(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    key = lambda *x: hashlib.sha256(json.dumps(x, ensure_ascii=False).encode()).hexdigest()
    assert [r[0] for r in df.select(graph.fact_key(F.lit("c"), F.col("n"))).collect()] == [key("c", n) for n in names]


def test_facts_are_keyed_and_validated_without_extra_work(spark):
    df = spark.createDataFrame([("v", f"c{i}", 0.0, 1.0, "A", "p", "B", "A p B") for i in range(9)], FACT)
    plan = graph.keyed_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    sources = spark.createDataFrame([(f"c{i}", "A p B") for i in range(9)], "chunk_id string, transcript string")
    plan = graph.validated(df, sources)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("_folded(")  # printed from the top: folding is below the join


def test_pages_of_a_scroll(spark, tmp_path):
    rows = [(v, i, f"{v}{i}", [0.0]) for v, n in (("a", 700), ("b", 1), ("c'd", 255), ("e", 30)) for i in range(n)]
    chunks = spark.createDataFrame(rows, "video_id string, chunk_index int, transcript string, visual array<float>").orderBy(F.rand(1))
    store.write_sorted(chunks, f"{tmp_path}/chunks")
    lies = spark.read.parquet(f"{tmp_path}/chunks")
    want = sorted((r[0], r[1]) for r in rows)
    got, after = [], None
    while page := [(r.video_id, r.chunk_index) for r in store.scroll(lies, after).collect()]:
        got.append(page)
        after = page[-1]
    assert [x for p in got for x in p] == want and {len(p) for p in got[:-1]} == {store.PAGE}
    numbered = sorted((r.page, r.place, r.video_id, r.chunk_index) for r in store.pages(chunks).collect())
    assert [r[2:] for r in numbered] == want and [r[:2] for r in numbered] == [divmod(i, store.PAGE) for i in range(len(want))]
    assert [r.chunk_index for r in store.scroll(lies, ("a", 690), "a").collect()] == list(range(691, 700))
    plan = store.scroll(lies, ("c'd", 3))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(video_id,c'd)" in plan and "visual" not in plan and "TakeOrderedAndProject" in plan
    files = lies.select(F.input_file_name().alias("f"), "video_id").groupBy("f").agg(F.min("video_id").alias("low"), F.max("video_id").alias("high")).orderBy("low").collect()
    assert all(x.high <= y.low for x, y in zip(files, files[1:]))  # ranges: a page's files are those at its key
    assert store.pages(chunks.limit(0)).count() == 0 and store.scroll(chunks.limit(0)).count() == 0


def test_facts_of_the_tables_become_edges_where_they_lie_and_entities_by_their_names(spark):
    from kairoscope.plans import catalogue
    from kairoscope.sources import tables

    folder = "/root/testdata/sf0.001"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6k")  # suppliers and nations go out, orders do not
    try:
        for facts, own in ((tables.supply_facts, catalogue.supply), (tables.trade_facts, catalogue.trade)):
            plan = own(spark, folder, True)[1]._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(chunk_id" in plan and not re.search(r"hashpartitioning\(chunk_id#\d+, subject_key", plan)
            want = graph.keyed_facts(facts(spark, folder))
            got = own(spark, folder, True)[0].select(want.columns)
            assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_the_first_name_counts_where_an_entity_has_several(spark):
    rows = [("c1", "v", 2.0, "Bob", "likes", "tea"), ("c0", "v", 1.0, "BOB", "likes", "Tea"), ("c2", "u", 9.0, "ann", "likes", "bob")]
    df = spark.createDataFrame([(c, v, t, t + 1, s, p, o, f"{s} {p} {o}") for c, v, t, s, p, o in rows], "chunk_id string, video_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string")
    keyed = graph.keyed_facts(df.withColumn("fact_key", graph.fact_key(*[F.col(c) for c in graph.FACT])))
    found = {r.entity_key: (r.canonical_name, list(r.aliases), r.n_facts) for r in graph.resolved_entities(keyed).collect()}
    assert found == {"bob": ("bob", ["BOB", "Bob", "bob"], 3), "tea": ("Tea", ["Tea", "tea"], 2), "ann": ("ann", ["ann"], 1)}


def test_edges_of_line_items_are_told_apart_by_numbers_in_tasks_of_one_size(spark, tmp_path, monkeypatch):
    """Suppliers and nations of one name are one, rows given twice are one, names of one key stay two wordings; a larger
    table makes more tasks, and no sort of wide rows is left."""
    from kairoscope.plans import catalogue
    from kairoscope.sources import tables

    given = {
        "lineitem": ([(o, p, s, "N") for o in range(1, 9) for p in (1, 2) for s in (1, 2, 3, 3)], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"),
        "orders": ([(o, o % 3, "1-URGENT") for o in range(1, 8)] + [(1, 1, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "supplier": ([(1, "Ab", 0), (2, "Ab", 1), (3, "AB", 2), (3, "AB", 2)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(0, 0), (1, 1), (2, 2)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "X"), (1, "X"), (2, "Y")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(tables, "LINE_BYTES", 100, raising=False)
    for made, keyed in ((catalogue.supply, tables.supply_facts), (catalogue.trade, tables.trade_facts)):
        edges = made(spark, str(tmp_path), True)[1]
        want = graph.fact_edges(graph.keyed_facts(keyed(spark, str(tmp_path))))
        columns = [c for c in want.columns]
        assert sorted(map(tuple, edges.select(columns).collect())) == sorted(map(tuple, want.collect()))
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        assert "evidence" not in "".join(x for x in plan.splitlines() if "Window" in x)
        (tasks,) = re.findall(r"RepartitionByExpression \[chunk_id#\d+\], (\d+)", plan)
        assert int(tasks) > spark.sparkContext.defaultParallelism


def _logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_names_that_are_their_own_key_are_not_shuffled_twice(spark, monkeypatch):
    """entity_anchors. A name equal to its key goes as null and comes back, also next to other names of that key."""
    rows = [("c1", "v", 2.0, "bob", "likes", "tea"), ("c0", "v", 1.0, "Bob", "likes", "tea"), ("c2", "u", 9.0, "ann", "likes", "bob"), ("c3", "w", 0.0, "BOB", "likes", "ann")]
    df = spark.createDataFrame([(c, v, t, t + 1, s, p, o, f"{s} {p} {o}") for c, v, t, s, p, o in rows], "chunk_id string, video_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string")
    keyed = graph.keyed_facts(df.withColumn("fact_key", graph.fact_key(*[F.col(c) for c in graph.FACT])))
    written, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda rows, name: (written.update({name: rows}), write(rows, name))[1])
    found = {r.entity_key: (r.canonical_name, list(r.aliases), r.n_facts) for r in graph.resolved_entities(keyed).collect()}
    assert found == {"bob": ("bob", ["BOB", "Bob", "bob"], 4), "tea": ("tea", ["tea"], 2), "ann": ("ann", ["ann"], 2)}
    grouped = next(i for i, x in enumerate(_logical(written["names"])) if "Aggregate" in x)
    assert "coalesce(name" in "".join(_logical(written["names"])[: grouped + 1])


def test_texts_are_split_once_and_only_where_a_term_stands(spark):
    """fact_search. Terms inside longer words do not count; words with the article are found without it."""
    rows = [("c1", "ann", "has", "part#17"), ("c1", "ann", "sees", "part#170"), ("c2", "بيت", "has", "الكتاب"), ("c3", "bob", "has", "part#2"), ("c4", "ann", "n", "17")]
    facts = spark.createDataFrame([("v", c, float(c[1]), s, p, o, f"{s} {p} {o}") for c, s, p, o in rows], "video_id string, chunk_id string, start_timestamp double, subject_key string, predicate_key string, object_key string, evidence string")
    terms = F.array(*map(F.lit, ("17", "n", "كتاب")))
    found = [(r.chunk_id, r.facts, list(r.matched_terms), r.score) for r in graph.fact_search(facts, terms, 9).collect()]
    assert found == [("c4", 1, ["17", "n"], 2), ("c1", 1, ["17"], 1), ("c2", 1, ["كتاب"], 1)]
    assert graph.fact_search(facts, F.array().cast("array<string>"), 9).count() == 0
    plan = _logical(graph.holding(facts, F.array("predicate_key", "subject_key")))  # no constants to fold
    assert sum("regexp_extract_all" in x for x in plan) == 1 and not any("Filter" in x and "regexp_extract_all" in x for x in plan)


def test_fact_search_of_the_tables_sorts_no_facts(spark):
    """edges are told apart by numbers, so no window picks one of equal facts."""
    from kairoscope.plans import catalogue

    plan = _logical(catalogue.fact_search(spark, "/root/testdata/sf0.001"))
    assert not any("row_number" in x or "fact_key" in x for x in plan)


def test_keys_are_made_for_edges_that_may_be_among_the_first(spark):
    """community_reports, community_summaries. Ties at the cut are told apart by keys made after it."""
    rows = [("v", f"c{i}", float(i // 3), float(i), s, "p", "p", o, f"e{i}") for i in range(30) for s, o in (("a", "b"), ("b", "a"), ("a", "x"))]
    edges = graph.with_edge_key(spark.createDataFrame(rows, "video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject_key string, predicate string, predicate_key string, object_key string, evidence string"))
    members = spark.createDataFrame([("L0", "a"), ("L0", "b"), ("L1", "a"), ("L1", "b"), ("L1", "x"), ("L2", "x")], "community_id string, entity_key string")
    for most in (1, 4, 7, 500, None):
        want = graph.internal_facts(edges, members, most)
        got = graph.internal_facts(edges.drop("edge_key"), members, most).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = _logical(graph.internal_facts(edges.drop("edge_key"), members, 4))
    made, cut = (next(i for i, x in enumerate(plan) if word in x) for word in ("sha2(", "rank(video_id"))
    assert made < cut and sum("sha2(" in x for x in plan) == 1  # the plan is read from its end
