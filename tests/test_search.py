import random

import pytest
from pyspark.sql import functions as F

from kairoscope.functions.projections import frame_url
from kairoscope.functions.vectors import confidence, cosine, cosine_with, normalized
from kairoscope.operators import answer, evaluate, search, windows

CHUNK = "chunk_id string, video_id string, start_timestamp double, end_timestamp double, transcript string, frame_path string, frame_sha256 string, visual array<float>, audio array<float>"


def test_windows(spark):
    videos = spark.createDataFrame([("a", 3.0), ("b", 8.0), ("c", 9.0), ("d", 10.0), ("e", 145.0), ("f", 0.0)], "video_id string, duration double")
    got = windows.chunk_windows(videos)
    assert {r.video_id: r.n for r in got.groupBy("video_id").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 2, "c": 3, "d": 3, "e": 37}
    last = got.where("video_id = 'c'").orderBy(F.desc("chunk_index")).first()
    assert (last.start, last.end, last.mid) == (8.0, 9.0, 8.5)
    kept = windows.readable_windows(got, got.where("not (video_id = 'c' and chunk_index = 1)"))
    assert [r.chunk_index for r in kept.where("video_id = 'c'").orderBy("start").collect()] == [0, 1]


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(1)
    w = [(v, i, *sorted((rng.randrange(0, 400) / 10, rng.randrange(0, 400) / 10))) for v in "ab" for i in range(40)] + [("a", 99, 4.0, 9.0)]
    s = [(v, i, *sorted((rng.randrange(0, 400) / 10, rng.randrange(0, 400) / 10)), "t") for v in "ab" for i in range(40)] + [("a", 90 + i, x, y, "t") for i, (x, y) in enumerate([(0.0, 4.0), (3.9, 4.1), (9.0, 10.0), (8.9, 12.0), (7.0, 6.0)])]
    got = windows.interval_join(spark.createDataFrame(w, "video_id string, chunk_index int, start double, end double"), spark.createDataFrame(s, "video_id string, seg_idx int, start double, end double, text string"))
    want = sorted((a[0], a[1], b[1]) for a in w for b in s if a[0] == b[0] and b[3] > a[2] and b[2] < a[3])
    assert sorted((r.video_id, r.chunk_index, r.seg_idx) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_intervals_are_copied_by_levels(spark):
    rng = random.Random(2)
    w = [("a", i, x, x + rng.choice([0.5, 5.0, 70.0, 3600.0, 40000.0])) for i in range(60) for x in [rng.uniform(-5000, 90000)]] + [(None, 98, 0.0, 9.0), ("a", 99, None, 9.0), ("a", 100, 0.0, None)]
    s = [("a", i, x, x + rng.choice([0.5, 4.0, 3600.0, 86400.0])) for i in range(60) for x in [rng.uniform(-5000, 90000)]] * 2 + [(None, 97, 0.0, 9.0)]
    ws, ss = spark.createDataFrame(w, "video_id string, chunk_index int, start double, end double"), spark.createDataFrame(s, "video_id string, seg_idx int, start double, end double")
    got = sorted((r.chunk_index, r.seg_idx) for r in windows.interval_join(ws, ss).collect())
    assert got == sorted((a[1], b[1]) for a in w for b in s if a[0] and a[0] == b[0] and None not in a + b and b[3] > a[2] and b[2] < a[3])
    spans = spark.range(1, 3000).select(F.col("id").alias("n"), (F.col("id") * 7919 % 5000 - 2500).alias("low")).withColumn("high", F.col("low") + F.col("n") - 1)
    cells = spans.select("n", F.inline(windows.cells(F.col("low"), F.col("high"))))
    per = cells.groupBy("n").agg(F.count("*").alias("copies"), F.sum(F.expr("shiftleft(1L, level)")).alias("buckets"))
    assert per.count() == 2999 and per.where("copies > 2 * floor(log2(n)) + 1 or buckets <> n").count() == 0
    points = spans.where("n < 200").select("n", F.explode(F.sequence("low", "high")).alias("p"))
    held = points.select("n", "p", F.inline(windows.holders(F.col("p"), 7))).join(cells, ["n", "level", "cell"]).groupBy("n", "p").count()
    assert held.count() == sum(range(200)) and held.where("count <> 1").count() == 0  # each bucket in one cell


def test_intervals_of_short_videos_are_not_cut(spark):
    """A few long intervals a video meet by the video, each row once; those of a longer video beside them are cut."""
    rng = random.Random(3)
    row = lambda v, i: (v, i, x := float(rng.randrange(2500)), x + rng.choice([-200.0, 3.0, 900.0, 2400.0]))
    few, many = [row(f"v{k}", i) for k in range(30) for i in range(9)], [row("long", i) for i in range(50)]
    side = lambda rows, key: spark.createDataFrame(rows, f"video_id string, {key} int, start double, end double")
    for rows in (few, few + many):
        got = windows.interval_join(side(rows, "one"), side(rows, "other"), 1.0)
        want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and b[3] > a[2] and b[2] < a[3])
        assert sorted((r.video_id, r.one, r.other) for r in got.collect()) == want
    plan = windows.interval_join(side(few, "one"), side(few, "other"), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1:] == [None, None]
    assert df.select(normalized(F.col("a"))).first()[0] == [1.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (None,), (3.0,)], "s double").select(confidence(F.col("s"))).collect()] == [0.5, 0.5, 1.0]
    assert [r[0] for r in spark.createDataFrame([("/a/b.jpg",), ("",), (None,), ("c\\d.png",)], "p string").select(frame_url(F.col("p"))).collect()] == ["/frames/b.jpg", "", "", "/frames/d.png"]


def test_top_k_is_taken_in_order_and_skips_missing_vectors(spark):
    rows = [(f"c{i}", [float(i), 1.0]) for i in range(5)] + [("z", None), ("zero", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    hits = search.ranked(df, [1.0, 0.0], 3)
    assert [r.chunk_id for r in hits.collect()] == ["c4", "c3", "c2"]
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()


def test_fusion(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 2)], "v int, a int")
    got = [round(r[0], 4) for r in df.select(search.fusion_score(F.col("v"), F.col("a"), 0.5, 0.5)).collect()]
    assert got == [1.0, 0.5, 0.4919]


def test_exact_matches_stand_alone(spark):
    rows = [(f"c{i}", "v", float(i), i + 5.0, "the magic phrase here" if i == 3 else "other", None, None, [1.0, float(i)], [1.0, float(i)]) for i in range(8)]
    chunks = spark.createDataFrame(rows, CHUNK)
    got = search.hybrid(chunks, [1.0, 0.0], [1.0, 0.0], "Magic phrase!", 3).collect()
    assert [(r.chunk_id, r.text_match) for r in got] == [("c3", True)]
    assert len(search.hybrid(chunks, [1.0, 0.0], [1.0, 0.0], "absent words", 3).collect()) == 8


def plain_dedup(rows, visual):
    kept = []
    for r in sorted(rows, key=lambda r: (not r[1], -r[2], r[0])):
        clash = lambda k: max(k[4], r[4]) < min(k[5], r[5]) and (k[3] == r[3] or (k[1] and r[1]) or (r[6] and k[6] == r[6] and (visual or k[7] == r[7])))
        if not any(clash(k) for k in kept):
            kept.append(r)
    return [k[0] for k in kept]


@pytest.mark.parametrize("visual", [False, True])
def test_greedy_suppression(spark, visual):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        start = rng.randrange(0, 300) / 2
        rows.append((f"c{i:03d}", rng.random() < 0.3, rng.randrange(20) / 20, rng.choice("abc"), start, start + rng.choice([0.0, 5.0]), rng.choice(["", "f1", "f2", None]), rng.choice(["x", "y"])))
    schema = "chunk_id string, text_match boolean, joint_score double, video_id string, start_timestamp double, end_timestamp double, frame_sha256 string, transcript string"
    hits = spark.createDataFrame(rows, schema)
    for k, block in ((1000, 2000), (1000, 7), (12, 5), (None, 2000), (3, 0)):
        got = [r.chunk_id for r in search.deduplicated(hits, k, visual, block).orderBy(F.desc("text_match"), F.desc("joint_score"), "chunk_id").collect()]
        assert got == plain_dedup(rows, visual)[:k]
    few = [("1", False, 0.9, "v", 0.0, 5.0, "", ""), ("2", False, 0.8, "v", 4.0, 9.0, "", ""), ("3", False, 0.7, "v", 8.0, 13.0, "", ""), ("4", False, 0.85, "w", 4.0, 9.0, "", "")]
    kept = lambda rows: sorted(r.chunk_id for r in search.deduplicated(spark.createDataFrame(rows, schema), 10).collect())
    assert kept(few) == ["1", "3", "4"]
    assert kept([(a, True, *rest) for a, _, *rest in few]) == ["1", "3"]


def test_many_hits_of_one_phrase(spark):
    """100,000 hits that match the text at 4,000 moments, many of each: as the walk keeps them."""
    rng = random.Random(6)
    rows = [(f"c{i}", True, rng.random(), f"v{i % 50}", float(rng.randrange(4000)), None, "", "") for i in range(100_000)]
    rows = [(*r[:5], r[4] + 5.0, *r[6:]) for r in rows]
    kept, taken = [], set()
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if not any(int(r[4]) + d in taken for d in range(-4, 5)):
            taken.add(int(r[4]))
            kept.append(r[0])
    hits = spark.createDataFrame(rows, "chunk_id string, text_match boolean, joint_score double, video_id string, start_timestamp double, end_timestamp double, frame_sha256 string, transcript string")
    assert sorted(r.chunk_id for r in search.deduplicated(hits, None).collect()) == sorted(kept) and len(kept) > 400


def test_routing(spark):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["photo", "quote", "photo quote", "hello", "الصورة", "كلمة", "photo, please", "show me the photo?", "what was said, exactly?", "الصُّورَة؟", ""])], "query_id long, text string")
    rows = search.weighed(search.route(asked)).orderBy("query_id").collect()
    assert [r.intent for r in rows] == ["visual", "audio", "combined", "combined", "visual", "audio", "visual", "visual", "audio", "visual", "combined"]
    for r in rows:  # one query alone is understood as in a table
        one = search.understood(spark, r.text)
        assert all(one[c] == r[c] for c in ("intent", "explicit", "visual_focused", "v_weight", "a_weight", "stripped"))
    auto = search.auto_route(asked, spark.createDataFrame([(3, 0.8), (0, 1.0)], "query_id long, coverage double")).orderBy("query_id").collect()
    assert [r.intent for r in auto][:4] == ["visual", "audio", "combined", "audio"]


def test_fused_search_has_cues_of_its_own(spark):
    seen = lambda q: search.understood(spark, q)
    assert (seen("photo of a cat").v_weight, seen("photo of a cat").stripped) == (0.5, "photo of a cat")
    assert (seen("الصُّورة،  of a  cat").v_weight, seen("الصُّورة،  of a  cat").a_weight, seen("الصُّورة،  of a  cat").stripped) == (0.6, 0.4, "of a cat")
    assert (seen("قالَ: cat").v_weight, seen("قالَ: cat").stripped) == (0.4, "cat")
    assert (seen("صورة قال").v_weight, seen("صورة قال").stripped) == (0.5, "صورة قال")


def test_batched_top_k_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]
    rows = [(f"c{i:04d}", vec()) for i in range(700)] + [("z", None), ("y", [0.0, 0.0, 0.0]), ("x", [1.0, 2.0]), ("w", [1.0, None, 2.0])]
    asked = [(i, vec()) for i in range(12)] + [(90, [0.0, 0.0, 0.0]), (91, None)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = []
    for q, v in asked:
        if v and any(v):
            order = sorted((-round(cos(v, e), 9), c) for c, e in rows if e and len(e) == 3 and None not in e and any(e))
            want += [(q, c, -s, r + 1) for r, (s, c) in enumerate(order[:5])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    for most in (10_000, 4):
        monkeypatch.setattr(search, "MOST_QUERIES", most)
        got = search.ranked_batch(df, queries, 5).collect()
        assert sorted((r.query_id, r.chunk_id, round(r.sim, 9), r["rank"]) for r in got) == sorted(want)
    assert "Cartesian" not in search.ranked_batch(df, queries, 5)._jdf.queryExecution().executedPlan().toString()


def test_phrases_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("ab abc b ca river".split()) for _ in range(rng.randrange(12)))) for i in range(80)] + [(100, None)]
    phrases = [(0, "ab"), (1, "b ca"), (2, "river river"), (3, ""), (4, None), (5, "ab"), (6, "c ab"), (7, "absent")]
    docs, asked = spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame(phrases, "item_id long, p string")
    want = sorted((d, i) for d, t in texts for i, p in phrases if t is not None and p and p in t)
    for most in (10_000, 2):
        monkeypatch.setattr(search, "MOST_QUERIES", most)
        met = search.containing(docs, asked, "t", "p")
        assert sorted((r.doc_id, r.item_id) for r in met.collect()) == want
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_sources_and_metrics(spark):
    t = spark.createDataFrame([(1, "c1", "v", 0.0, 5.0, "said", "/f")], "position int, chunk_id string, video_id string, start_timestamp double, end_timestamp double, transcript string, frame_url string")
    f = spark.createDataFrame([(1, "c1", "v", 0.0, 5.0, "a", "b", "c", "e1"), (2, "c2", "v", 0.0, 5.0, "a", "b", "d", ""), (3, "c2", "v", 0.0, 5.0, "a", "b", "e", "e3")], "position int, chunk_id string, video_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string")
    got = answer.sources(t, f, 5).orderBy("citation_id").collect()
    assert [(r.citation_id, r.chunk_id, r.content, r.frame_url, r.facts) for r in got] == [("S1", "c1", "said", "/f", ["a — b — c"]), ("S2", "c2", "e3", "", ["a — b — d", "a — b — e"])]
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 5, True), (3, 1, False)], "query_id int, rank int, relevant boolean")
    m = evaluate.retrieval_metrics(hits, 3).first()
    assert (m.queries, round(m.recall_at_k, 4), round(m.mrr, 4)) == (3, 0.3333, round((0.5 + 0.2) / 3, 4))


def test_vectors_equal_to_their_query_tie_at_exactly_one(spark):
    rng = random.Random(0)
    vectors = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    own = [cosine_with(F.array(*map(F.lit, v)), v) for v in vectors]
    assert list(spark.range(1).select(*own).first()) == [1.0] * 40
    none = spark.createDataFrame([(None,), ([0.0, 0.0],)], "e array<float>").select(cosine_with(F.col("e"), [1.0, 2.0]), cosine_with(F.array(F.lit(1.0), F.lit(2.0)), [0.0, 0.0]))
    assert [tuple(r) for r in none.collect()] == [(None, None)] * 2
