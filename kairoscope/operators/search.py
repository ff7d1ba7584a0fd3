"""Vector top-k, unimodal, fused and routed search over chunks.

Queries known to the driver (one vector) use TakeOrdered; tables of queries go out in blocks of a checked size and
keep the best of each task before they are ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from kairoscope.functions import fuzzy
from kairoscope.functions import text as T
from kairoscope.functions.projections import frame_url, snippet
from kairoscope.functions.vectors import clip, confidence, cosine_with
from kairoscope.operators.token_index import TokenIndex
from kairoscope.operators.windows import WINDOW
from kairoscope.sources.store import discard, materialize

RRF_K = 60
#: Rows of queries that may be broadcast; beyond, they are joined in blocks.
MOST_QUERIES = 10_000
#: Vectors that are multiplied with a block of queries at a time, and digits to which similarities count as equal.
ROWS_AT_ONCE, DIGITS = 512, 12
#: Hits that suppression looks at at a time.
BLOCK = 2_000
EXACT_BONUS, NEAR_BONUS, COVERAGE_BONUS, NEAR_COVERAGE = 2.0, 1.5, 0.5, 0.75


def ranked(df: DataFrame, vector: list[float], k: int, column: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k rows most similar to a vector, with sim; rows without the vector, or with a zero one, are no candidates."""
    return df.withColumn("sim", cosine_with(F.col(column), vector)).where("sim is not null").orderBy(F.desc("sim"), key).limit(k)


def ranked_batch(df: DataFrame, queries: DataFrame, k: int, column: str = "embedding", key: str = "chunk_id", query_column: str = "vector") -> DataFrame:
    """(query_id, key, sim, rank) for a table of queries (query_id, vector): rank 1 to k within each query.

    Queries meet all rows in blocks of at most MOST_QUERIES, each sent to every task once, which multiplies batches of
    vectors with it and holds the k best of each query: the shuffle sees k rows a task and query, never the pairs.
    Vectors of another length than the query's, with a null or of zeros are no candidates. Similarities that agree to
    DIGITS digits are ties, which go by key.
    """
    count = queries.count()
    blocks = max(1, -(-count // MOST_QUERIES))
    kinds = df.schema[key], queries.schema["query_id"]
    schema = StructType([StructField("number", IntegerType()), StructField(key, kinds[0].dataType), StructField("sim", DoubleType())])
    rows, out = df.select(F.col(key), F.col(column).alias("vector")).where(F.col(key).isNotNull()), None
    for b in range(blocks):
        few = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        asked = [(r["query_id"], r[query_column]) for r in few.select("query_id", query_column).collect() if r[query_column] is not None]  # a block at most
        sent = df.sparkSession.sparkContext.broadcast([np.asarray(v, np.float64) for _, v in asked])
        near = rows.mapInArrow(_nearest(sent, k), schema)
        names = df.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], StructType([StructField("number", IntegerType()), kinds[1]]))
        best = near.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(F.desc("sim"), key))).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "number").select("query_id", key, "sim", "rank")
        out = best if out is None else out.unionByName(best)
    return out


def _nearest(sent: Broadcast, k: int) -> Callable:
    """mapInArrow's function of (key, vector) batches: the k best of each of the vectors sent over all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: list[np.ndarray] = sent.value
        width = {len(v) for v in vectors}
        units = {w: [(i, v / n) for i, v in enumerate(vectors) if len(v) == w and (n := np.sqrt(v @ v)) > 0] for w in width}
        best_sim, best_key, kind = np.full((len(vectors), k), -np.inf), np.full((len(vectors), k), None, object), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            lists = batch.column(1)
            size = np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
            for w, own in units.items():
                at = np.flatnonzero(size == w)
                for low in range(0, len(at) if own else 0, ROWS_AT_ONCE):
                    rows = at[low : low + ROWS_AT_ONCE]
                    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w)
                    length = np.sqrt((x * x).sum(axis=1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        x /= length[:, None]
                    good = np.isfinite(x).all(axis=1)  # neither zeros nor nulls
                    keys = np.array(batch.column(0).take(pa.array(rows[good])).to_pylist(), object)
                    if not len(keys):
                        continue
                    sims = np.round(x[good] @ np.stack([v for _, v in own]).T, DIGITS)
                    for j, (i, _) in enumerate(own):
                        s = sims[:, j]
                        floor = max(best_sim[i, -1], np.partition(s, -k)[-k] if len(s) > k else -np.inf)
                        if (take := np.flatnonzero(s >= floor)).size:
                            pool = [*zip((-s[take]).tolist(), keys[take].tolist()), *((-a, c) for a, c in zip(best_sim[i].tolist(), best_key[i]) if c is not None)]
                            pool = heapq.nsmallest(k, pool)
                            best_sim[i, : len(pool)], best_key[i, : len(pool)] = [-a for a, _ in pool], [c for _, c in pool]
        if kind is not None:
            number, place = np.nonzero(best_sim > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(best_key[number, place].tolist(), kind), pa.array(best_sim[number, place])], names=["number", "key", "sim"])

    return run


def visual_search(chunks: DataFrame, vector: list[float], k: int) -> DataFrame:
    hits = ranked(chunks, vector, k, "visual")
    return hits.select("chunk_id", "video_id", "start_timestamp", "end_timestamp", confidence(F.col("sim")).alias("confidence"), F.col("sim").alias("visual_similarity"), snippet(F.col("transcript")).alias("snippet"), frame_url(F.col("frame_path")).alias("frame_url"))


def lexical(chunks: DataFrame, phrase: str, index: TokenIndex | None = None) -> DataFrame:
    """(chunk_id, exact, coverage, terms): exact phrase and share of the query's tokens that are there or nearly there,
    of chunks with either. With a token index only transcripts that may hold the phrase are read."""
    spark = chunks.sparkSession
    asked = T.transcript_tokens(F.lit(phrase))
    if index:
        covered = index.coverage(phrase).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        rows = chunks.select("chunk_id", "transcript").join(index.candidates(phrase), "chunk_id", "left_semi")
    else:
        query = spark.range(1).select(F.col("id").alias("_q"), F.lit(phrase).alias("_asked"))
        covered = fuzzy.coverage(chunks, query, "chunk_id", "transcript", "_q", "_asked").select("chunk_id", "coverage")
        rows = chunks.select("chunk_id", "transcript")
    exact = rows.where(T.contains_phrase(T.normalize_transcript(F.col("transcript")), T.normalize_transcript(F.lit(phrase)))).select("chunk_id", F.lit(True).alias("exact"))
    both = covered.join(exact, "chunk_id", "full_outer")
    return both.select("chunk_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.size(asked).alias("terms"))


def containing(docs: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """Pairs of a document (its columns but the text) and a phrase that it contains; both normalised, an empty phrase is in none. Phrases are a
    stated set of queries: at most MOST_QUERIES are sent out at a time, as one automaton that finds them all in a
    single pass over each document."""
    asked = phrases.where(F.col(phrase) != "")
    blocks = max(1, -(-asked.count() // MOST_QUERIES))
    schema, out = StructType([*[f for f in docs.schema if f.name != text], StructField("_phrase", StringType())]), None
    for b in range(blocks):
        few = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(phrase), F.lit(blocks)) == b)
        found = docs.mapInArrow(_all_found([r[0] for r in few.select(phrase).distinct().collect()], docs.columns.index(text)), schema)
        met = found.join(F.broadcast(few), found["_phrase"] == few[phrase]).drop("_phrase")
        out = met if out is None else out.unionByName(met)
    return out


def _all_found(phrases: list[str], column: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in phrases:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches if phrases else ():
            found = [sorted({p for _, p in machine.iter(t)}) if t else [] for t in batch.column(column).to_pylist()]
            keys = batch.select([n for i, n in enumerate(batch.schema.names) if i != column])  # texts stay here
            rows = keys.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([p for f in found for p in f], pa.string())], names=[*rows.schema.names, "_phrase"])

    return run


def audio_search(chunks: DataFrame, vector: list[float], phrase: str, k: int, index: TokenIndex | None = None) -> DataFrame:
    """Transcript vectors and words together: similarity plus a bonus for the phrase or for covered words."""
    hits = ranked(chunks, vector, max(20 * k, 50), "audio").select("chunk_id", "sim")
    both = hits.join(lexical(chunks, phrase, index), "chunk_id", "full_outer")
    bonus = F.when(F.col("exact"), EXACT_BONUS).when((F.col("terms") >= 2) & (F.col("coverage") >= NEAR_COVERAGE), NEAR_BONUS).otherwise(F.coalesce(COVERAGE_BONUS * F.col("coverage"), F.lit(0.0)))
    top = both.withColumn("rank_score", F.coalesce("sim", F.lit(0.0)) + bonus).orderBy(F.desc("rank_score"), "chunk_id").limit(k)
    rows = chunks.select("chunk_id", "video_id", "start_timestamp", "end_timestamp", "transcript", "frame_path")
    joined = rows.join(F.broadcast(top), "chunk_id")  # at most k rows
    return joined.select("chunk_id", "video_id", "start_timestamp", "end_timestamp", confidence(F.col("sim")).alias("confidence"), F.col("sim").alias("audio_similarity"), F.coalesce("exact", F.lit(False)).alias("text_match"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "rank_score", snippet(F.col("transcript")).alias("snippet"), frame_url(F.col("frame_path")).alias("frame_url"))


def fusion_score(v_rank: Column, a_rank: Column, v_weight: float, a_weight: float) -> Column:
    """Reciprocal-rank fusion scaled to 1 for rank 1; a missing rank adds nothing."""
    part = lambda r: F.coalesce(F.lit(RRF_K + 1.0) / (RRF_K + r), F.lit(0.0))
    return v_weight * part(v_rank) + a_weight * part(a_rank)


def hybrid(chunks: DataFrame, visual: list[float], audio: list[float], phrase: str, k: int, v_weight: float = 0.5, a_weight: float = 0.5) -> DataFrame:
    """Fused ranking before de-duplication: if any chunk has the exact phrase, only such chunks stand."""
    depth = max(20 * k, 50)
    order = lambda n: F.row_number().over(W.orderBy(F.desc("sim"), "chunk_id")).alias(n)  # noqa: E731  over at most `depth` rows
    v = ranked(chunks, visual, depth, "visual").select("chunk_id", order("v_rank"))
    a = ranked(chunks, audio, depth, "audio").select("chunk_id", order("a_rank"))
    said = T.contains_phrase(T.normalize_transcript(F.col("transcript")), T.normalize_transcript(F.lit(phrase)))
    exact = chunks.where(said).select("chunk_id", F.lit(True).alias("text_match"))
    rows = v.join(a, "chunk_id", "full_outer").join(exact, "chunk_id", "full_outer").withColumn("text_match", F.coalesce("text_match", F.lit(False)))
    rows = rows.withColumn("a_rank", F.when(F.col("text_match"), F.lit(1)).otherwise(F.col("a_rank")))
    joint = fusion_score(F.col("v_rank"), F.col("a_rank"), v_weight, a_weight)
    rows = rows.withColumn("joint_score", F.round(F.when(F.col("text_match"), F.least(F.lit(1.0), joint + 0.1)).otherwise(joint), 4))
    any_exact = rows.agg(F.coalesce(F.max("text_match"), F.lit(False)).alias("_any"))
    return rows.crossJoin(F.broadcast(any_exact)).where("text_match or not _any").drop("_any")  # one row


def deduplicated(hits: DataFrame, k: int | None, visual_focused: bool = False, block: int = BLOCK) -> DataFrame:
    """The first k hits (all if None) that greedy suppression in rank order (text_match, joint_score, chunk_id) keeps: a
    hit goes if a kept one overlaps it in time and is of the same video, or both match the text, or both show one frame
    (and say the same, unless the query is visual).

    What is kept depends on better ranks only. The best `block` hits come to the driver, where they nearly always decide
    the first few; if they don't, all hits are suppressed in rounds, see suppressed().
    """
    order = ["o", "s", "chunk_id"]
    frame = F.nullif(F.col("frame_sha256"), F.lit(""))
    said = F.sha2(T.normalize_transcript(F.col("transcript")), 256)  # only whether two are equal counts
    rows = hits.select(
        F.when(F.col("text_match"), 0).otherwise(1).alias("o"), (-F.col("joint_score")).alias("s"), "chunk_id", "text_match", "joint_score", "video_id",
        F.col("start_timestamp").cast("double").alias("start_timestamp"), F.col("end_timestamp").cast("double").alias("end_timestamp"), "frame_sha256", frame.alias("frame"), said.alias("said"),
    )
    out = ["chunk_id", "text_match", "joint_score", "video_id", "start_timestamp", "end_timestamp", "frame_sha256"]
    part = rows.orderBy(*order).limit(block).collect() if k is not None and block else None
    kept: list = []
    for x in part or ():
        if len(kept) < k and not any(_clash(y, x, visual_focused) for y in kept):
            kept.append(x)
    if part is not None and (len(kept) >= k or len(part) < block):
        return hits.sparkSession.createDataFrame([tuple(r[c] for c in out) for r in kept], rows.select(*out).schema)  # at most k rows
    # a frame alone for a visual query; else a frame and what is said, which may not be null
    shown = F.col("frame") if visual_focused else F.concat("frame", F.lit(" "), "said")
    groups = F.array_compact(F.array(F.concat(F.lit("v"), "video_id"), F.when(F.col("text_match"), F.lit("t")), F.concat(F.lit("f"), shown)))
    spans = F.coalesce(F.col("start_timestamp") < F.col("end_timestamp"), F.lit(False))
    written = materialize(rows.withColumn("groups", F.when(spans, groups).otherwise(F.array().cast("array<string>"))), "hits")
    chosen = suppressed(written, F.struct(*order), k).select("chunk_id")
    found = written.join(chosen, "chunk_id", "left_semi")
    return (found if k is None else found.orderBy(*order).limit(k)).select(*out)


def suppressed(rows: DataFrame, rank: Column, k: int | None = None, width: float = WINDOW) -> DataFrame:
    """(chunk_id, rank) of the rows (chunk_id, start_timestamp, end_timestamp, groups) that stay if, in order of rank, each
    one goes that overlaps one that stays and shares a group with it; at least the first k of them, all if None.

    Rows are dealt into cells of a group and `width` seconds. A row that is the best open one of all its cells stays, and
    those go that clash with it; so in each round at least the best open row is decided, in most a share of all. A cell
    has one best row, so no pairs arise, however many share it. Each round is written and read back.
    """
    ranked_rows = rows.select("chunk_id", rank.alias("rank"), F.col("start_timestamp").alias("from"), F.col("end_timestamp").alias("to"), "groups")
    stay = [ranked_rows.where("size(groups) = 0").select("chunk_id", "rank")]
    times = F.sequence(F.floor(F.col("from") / width), F.floor(F.col("to") / width))
    cells = materialize(ranked_rows.select("chunk_id", "rank", "from", "to", F.explode("groups").alias("group"), times.alias("times")).select("*", F.explode("times").alias("time")).drop("times"), "cells")
    while (first := cells.agg(F.min("rank").alias("rank")).first()["rank"]) is not None:
        better = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(cells.schema["rank"].dataType, first)])
        if k is not None and len(stay) > 1 and sum(s.where(F.col("rank") < better).count() for s in stay) >= k:
            break
        best = cells.groupBy("group", "time").agg(F.min_by(F.struct("chunk_id", "from", "to"), "rank").alias("best"))
        met = cells.join(best, ["group", "time"])
        won = met.groupBy("chunk_id").agg(F.bool_and(F.col("chunk_id") == F.col("best.chunk_id")).alias("won"), F.first("rank").alias("rank")).where("won")
        won = materialize(won.select("chunk_id", "rank"), "stay")
        stay.append(won)
        clash = met.where((F.greatest("from", "best.from") < F.least("to", "best.to"))).select("chunk_id", F.col("best.chunk_id").alias("by"))
        gone = clash.join(won.select(F.col("chunk_id").alias("by")), "by", "left_semi").select("chunk_id").distinct()  # those that stay, too
        left = materialize(cells.join(gone, "chunk_id", "left_anti"), "cells")
        discard(cells)
        cells = left
    out = stay[0]
    for s in stay[1:]:
        out = out.unionByName(s)
    return out


def _clash(kept: Row, x: Row, visual_focused: bool) -> bool:
    if None in (kept.start_timestamp, kept.end_timestamp, x.start_timestamp, x.end_timestamp) or max(kept.start_timestamp, x.start_timestamp) >= min(kept.end_timestamp, x.end_timestamp):
        return False
    if (x.video_id is not None and kept.video_id == x.video_id) or (kept.text_match and x.text_match):
        return True
    return x.frame is not None and kept.frame == x.frame and (visual_focused or (x.said is not None and kept.said == x.said))


@cache
def _normalized_cues(words: tuple[str, ...]) -> str:
    one = SparkSession.active().range(1).select(*[T.normalize_transcript(F.lit(w)) for w in words]).first()
    return " ".join(dict.fromkeys(one))


def _cues(words: list[str]) -> Column:
    """Cue words, normalised as queries are (once, by the same expression), as one constant."""
    return F.split(F.lit(_normalized_cues(tuple(words))), " ")


def route(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with intent (visual, audio or combined) by their cue words, and whether a cue word decided it."""
    said = T.transcript_tokens(F.col(text))
    visual, audio, mixed = (F.arrays_overlap(said, _cues(c)) for c in (T.VISUAL_CUES, T.AUDIO_CUES, T.MIXED_CUES))
    return queries.withColumn("intent", F.when(mixed | (visual & audio), "combined").when(visual, "visual").when(audio, "audio").otherwise("combined")).withColumn("explicit", mixed | visual | audio)


def weighed(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with visual_focused, v_weight and a_weight of fused search, by its own cue words, and the query without them."""
    said = T.transcript_tokens(F.col(text))
    visual, audio = (F.arrays_overlap(said, _cues(c)) for c in (T.FUSION_VISUAL_CUES, T.FUSION_AUDIO_CUES))
    of = lambda seen, heard: F.when(visual & ~audio, seen).when(audio & ~visual, heard).otherwise(0.5)
    return queries.withColumns({"visual_focused": visual & ~audio, "v_weight": of(0.6, 0.4), "a_weight": of(0.4, 0.6), "stripped": without_cues(F.col(text))})


def without_cues(text: Column) -> Column:
    """The query without the cue words of fused search, single spaces between the rest; the query itself if none is left."""
    cues = _cues(T.FUSION_VISUAL_CUES + T.FUSION_AUDIO_CUES)
    left = F.array_join(F.filter(F.split(T.collapse(text), " "), lambda w: ~F.array_contains(cues, T.normalize_transcript(w))), " ")
    return F.when(left == "", text).otherwise(left)


def understood(spark: SparkSession, query: str) -> Row:
    """intent, explicit, visual_focused, v_weight, a_weight and stripped of one query, by the same columns as a table's."""
    return weighed(route(spark.range(1).select(F.lit(query).alias("text")))).first()


def auto_route(queries: DataFrame, best_coverage: DataFrame) -> DataFrame:
    """route(), but an inexplicit query whose words a transcript covers to three quarters goes to audio.

    best_coverage: (query_id, coverage), the largest of each query.
    """
    routed = route(queries).join(best_coverage, "query_id", "left")
    return routed.withColumn("intent", F.when(~F.col("explicit") & (F.coalesce("coverage", F.lit(0.0)) >= NEAR_COVERAGE), "audio").otherwise(F.col("intent")))


def calibrated(visual: Column, audio: Column) -> Column:
    """The older weighted sum of rescaled similarities; null below 0.10."""
    joint = 0.6 * clip((visual - 0.10) / 0.25) + 0.4 * clip((audio - 0.05) / 0.70)
    return F.when(joint >= 0.10, joint)
