"""Context assembly for questions: anchors, facts, communities, transcripts, sources, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairoscope.functions import text as T
from kairoscope.functions.vectors import cosine_with
from kairoscope.operators.graph import internal_facts, one_hop
from kairoscope.operators.search import ranked

# The sub-queries that a list question adds.
EXPANSIONS = [
    "أنواع الذكاء الاصطناعي المذكورة",
    "النوع الأول أو الفئة الأولى من الذكاء الاصطناعي",
    "النوع الثاني أو الفئة الثانية من الذكاء الاصطناعي",
    "النوع الثالث أو الفئة الثالثة من الذكاء الاصطناعي",
    "النوع الرابع أو الفئة الرابعة من الذكاء الاصطناعي",
]
ANCHORS, LEAST_ANCHOR = 5, 0.20


def similarity(column: Column, vector: list[float]) -> Column:
    return cosine_with(column, vector)


def anchors(entities: DataFrame, vector: list[float], terms: Column) -> DataFrame:
    """The five best entities (entity_key, canonical_name, embedding) by cosine plus shared words, with whether they
    pass the threshold: the list shows all five, expansion uses those that pass."""
    overlap = F.least(F.size(F.array_intersect(T.tokens(F.col("entity_key")), terms)), F.lit(3))
    score = similarity(F.col("embedding"), vector) + 0.08 * overlap
    return entities.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "entity_key").limit(ANCHORS).withColumn("used", F.col("score") >= LEAST_ANCHOR).select("entity_key", "canonical_name", "score", "used")


def reranked(facts: DataFrame, vector: list[float], terms: Column) -> DataFrame:
    """facts (subject, predicate, object, evidence, embedding of their sentence) with score: cosine plus the share of
    query words that they hold."""
    words = F.array_distinct(T.tokens(F.lower(F.concat_ws(" ", "subject", "predicate", "object", "evidence"))))
    overlap = F.size(F.array_intersect(words, terms)) / F.greatest(F.lit(1), F.size(terms))
    return facts.withColumn("score", similarity(F.col("embedding"), vector) + 0.12 * overlap)


def local_context(edges: DataFrame, named: DataFrame, found: DataFrame, vector: list[float], terms: Column, k: int, embed) -> DataFrame:
    """Facts around the anchors: cut by time first, then ranked. embed: sentence column to vector column."""
    near = one_hop(edges, found.where("used"), k).join(named.select("edge_key", "subject", "object"), "edge_key")
    return reranked(embed(near), vector, terms).orderBy(F.desc("score"), "edge_key")


def ranked_communities(reports: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k best communities over all levels by their summary, or report where that is missing or empty."""
    return reports.withColumn("score", similarity(F.col("embedding"), vector)).where("score is not null").orderBy(F.desc("score"), "community_id").limit(k)


def described(reports: DataFrame) -> DataFrame:
    return reports.withColumn("description", F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("report")))


def global_context(named: DataFrame, members: DataFrame, selected: DataFrame, vector: list[float], terms: Column, k: int, embed, video_id: str | None = None) -> DataFrame:
    """Facts inside the selected communities, of one video if given: so many of each by time, each edge once (best
    community first), ranked, capped."""
    chosen = members.join(F.broadcast(selected.select("community_id", F.col("score").alias("_c"))), "community_id")  # at most k communities
    gathered = internal_facts(named, chosen.select("community_id", "entity_key"), max(20, 12 * k), video_id).join(F.broadcast(selected.select("community_id", F.col("score").alias("_c"))), "community_id")
    once = gathered.withColumn("_n", F.row_number().over(W.partitionBy("edge_key").orderBy(F.desc("_c"), "community_id"))).where("_n = 1").drop("_n", "_c")
    return reranked(embed(once), vector, terms).orderBy(F.desc("score"), "edge_key").limit(max(8 * k, 24))


def expanded(query: str, text_is_list: bool) -> list[str]:
    return [query, *EXPANSIONS] if text_is_list else [query]


def best_per_chunk(chunks: DataFrame, vectors: list[list[float]], k: int, column: str = "audio") -> DataFrame:
    """Hits of several query vectors, each max(4k, 12) deep; a chunk keeps its best score, of equals the first query's.

    Chunks without transcript fall out after ranking: their rank is used up.
    """
    depth = max(4 * k, 12)
    hits = None
    for n, vector in enumerate(vectors):
        top = ranked(chunks, vector, depth, column)
        own = top.withColumn("query_no", F.lit(n)).withColumn("best_rank", F.row_number().over(W.orderBy(F.desc("sim"), "chunk_id")) - 1)  # over `depth` rows
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.where(F.coalesce("transcript", F.lit("")) != "")
    first = W.partitionBy("chunk_id").orderBy(F.desc("sim"), "query_no", "best_rank")
    best = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.orderBy(F.desc("sim"), "best_rank", "chunk_id")


def sources(transcripts: DataFrame, facts: DataFrame, k: int, is_list: bool = False) -> DataFrame:
    """Cited sources S1..Sn: transcript chunks in their order (position), then chunks that only facts name.

    transcripts (position, chunk_id, video_id, start_timestamp, end_timestamp, transcript, frame_url); facts (position,
    chunk_id, ..., subject, predicate, object, evidence). Content is the transcript, else the first evidence.
    """
    limit = max(1, min(k + (4 if is_list else 0), 10))
    base = ["chunk_id", "video_id", "start_timestamp", "end_timestamp"]
    a = transcripts.select(*base, F.lit(0).alias("kind"), "position", F.col("transcript").alias("content"), "frame_url", F.lit(None).cast("string").alias("fact"))
    b = facts.select(*base, F.lit(1).alias("kind"), "position", F.col("evidence").alias("content"), F.lit("").alias("frame_url"), T.fact_bullet(F.col("subject"), F.col("predicate"), F.col("object")).alias("fact"))
    order = F.struct("kind", "position")
    merged = a.unionByName(b).groupBy("chunk_id").agg(
        F.min(order).alias("place"), F.min_by("video_id", order).alias("video_id"), F.min_by("start_timestamp", order).alias("start_timestamp"), F.min_by("end_timestamp", order).alias("end_timestamp"),
        F.coalesce(F.min_by("content", F.when(F.col("content") != "", order)), F.lit("")).alias("content"), F.min_by("frame_url", order).alias("frame_url"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fact").isNotNull(), F.struct("position", "fact")))), lambda x: x["fact"]).alias("facts"),
    )
    top = merged.orderBy("place").limit(limit)
    return top.withColumn("citation_id", F.concat(F.lit("S"), F.row_number().over(W.orderBy("place")))).drop("place")  # at most ten rows


def evidence_answer(cited: DataFrame, most: int = 3, length: int = 900) -> DataFrame:
    """The answer without a model: the first sources quoted, with their numbers."""
    first = cited.withColumn("n", F.substring("citation_id", 2, 9).cast("int")).where(F.col("n") <= most)
    line = F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), F.substring("content", 1, length))
    rows = first.agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "citation_id"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("answer"), F.transform("rows", lambda r: r["citation_id"]).alias("cited"))
