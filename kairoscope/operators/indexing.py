"""The incremental indexer: candidates from the cache, from stored facts or from a model, validated and written by video."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kairoscope import schemas
from kairoscope.operators.graph import FACT, fact_key, first_of, routed_candidates, stated
from kairoscope.sources.media import extracted
from kairoscope.sources.store import cache_hits, discard, materialize, remove, replaced, upserted

#: Parts of each table, by a hash of the video; a run rewrites those of its videos.
BUCKETS = 64
#: What of which model the facts were made from.
RUNS = "video_id string, chunk_id string, transcript_hash string, model_id string, prompt_hash string"
CACHED = schemas.CACHE.removesuffix(", updated_at timestamp")


def spoken(chunks: DataFrame) -> DataFrame:
    """Chunks with a video, an id and something said, trimmed; of rows with one id the earliest."""
    said = F.regexp_replace("transcript", r"^\s+|\s+$", "")
    rows = chunks.select("video_id", "chunk_id", "start_timestamp", "end_timestamp", said.alias("transcript")).where("video_id is not null and chunk_id <> '' and transcript <> ''")
    return first_of(rows, ["chunk_id"], ["video_id", "start_timestamp", "end_timestamp", "transcript"])


def candidates(chunks: DataFrame, cache: DataFrame, runs: DataFrame, facts: DataFrame, model: Callable, model_id: str, prompt_hash: str, size: int = 5) -> DataFrame:
    """spoken chunks with transcript_hash, candidates and how they came by them, written once so that a model is asked once:
    `cached` for this transcript, model and prompt; `stored` facts of the same, where the cache has lost them; else
    `inferred`, in calls of `size` chunks of a video."""
    own = runs.where((F.col("model_id") == model_id) & (F.col("prompt_hash") == prompt_hash)).select("chunk_id", "transcript_hash", F.lit(True).alias("ran"))
    known = facts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*FACT))).alias("known"))  # those of one chunk
    found = cache_hits(chunks, cache, model_id, prompt_hash).join(own, ["chunk_id", "transcript_hash"], "left").join(known, "chunk_id", "left")
    how = F.when(F.col("hit"), "cached").when(F.col("ran"), "stored").otherwise("inferred")
    none = F.array().cast(known.schema["known"].dataType)
    have = F.when(F.col("hit"), F.col("candidates")).when(F.col("ran"), F.coalesce("known", none))
    found = materialize(found.select(*chunks.columns, "transcript_hash", have.alias("candidates"), how.alias("how")), "found", "zstd")
    asked = found.where("how = 'inferred'").drop("candidates")
    answered = routed_candidates(asked, extracted(asked, model, size))
    every = materialize(found.where("how <> 'inferred'").unionByName(answered.select(*found.columns)), "candidates", "zstd")
    discard(found)
    return every


def facts_of(chunks: DataFrame) -> DataFrame:
    """chunks with candidates to the facts that stand, each once. A chunk is one row, so none is moved."""
    stand = stated(chunks.select("video_id", "chunk_id", "start_timestamp", "end_timestamp", "transcript", "candidates"))
    return stand.withColumn("fact_key", fact_key(*[F.col(c) for c in FACT])).select(*[f.split()[0] for f in schemas.FACTS.split(", ")])


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the indexer's tables (facts, cache, runs) under path, with its bucket; empty if there is none yet."""
    schema = {"facts": schemas.FACTS, "cache": CACHED, "runs": RUNS}[name] + ", bucket int"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def index_videos(chunks: DataFrame, path: str, model: Callable[[], Callable[[list[tuple[str, str]]], list[dict]]], model_id: str, prompt_hash: str, size: int = 5) -> DataFrame:
    """Bring the tables under path up to date with the videos of `chunks` (all chunks of each) and return (video_id,
    chunk_id, how): see candidates(). The facts of a video are replaced as a whole, of videos without a spoken chunk and
    of those not given nothing changes. chunk_id is one chunk's over all videos.

    What a model said is in the cache before a fact is replaced, so a run that dies asks it nothing twice, and a repeated
    run leaves the same tables.
    """
    spark = chunks.sparkSession
    rows = materialize(spoken(chunks), "spoken", "zstd")
    videos = rows.select("video_id").distinct()
    touched = [r[0] for r in videos.select(_bucket()).distinct().collect()]  # at most BUCKETS
    old = {n: table(spark, path, n).where(F.col("bucket").isin(touched)).drop("bucket") for n in ("cache", "runs", "facts")}
    every = candidates(rows, old["cache"], old["runs"], old["facts"], model, model_id, prompt_hash, size)
    mine = [F.lit(model_id).alias("model_id"), F.lit(prompt_hash).alias("prompt_hash")]
    _put(f"{path}/cache", upserted(old["cache"], every.select("video_id", "chunk_id", "transcript_hash", *mine, "candidates"), ["video_id", "chunk_id"]), touched)
    _put(f"{path}/facts", replaced(old["facts"], facts_of(every), videos), touched)
    _put(f"{path}/runs", replaced(old["runs"], every.select("video_id", "chunk_id", "transcript_hash", *mine), videos), touched)
    how = materialize(every.select("video_id", "chunk_id", "how"), "how", "zstd")
    discard(every)
    discard(rows)
    return how


def _bucket():
    return F.pmod(F.xxhash64("video_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _put(path: str, rows: DataFrame, touched: list[int]) -> None:
    """Overwrite the touched buckets with rows, which may come from them: Spark puts what it wrote in their place once all
    of it is there. A video of very many chunks is many files."""
    spark, seen = rows.sparkSession, Observation()
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(4 * spark.sparkContext.defaultParallelism))
    after = rows.withColumn("bucket", _bucket()).repartition("bucket", share)
    held = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket"))).alias("held")  # a bit a bucket
    after.observe(seen, held).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in [b for b in touched if not (seen.get["held"] or 0) >> b & 1]:  # nothing is left to overwrite them
        remove(spark, f"{path}/bucket={b}")
