"""Commands: python -m kairoscope ingest | index | migrate | ask | benchmark.

Tables are Parquet folders. Models are named module:function; an encoder takes a text and returns a vector.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairoscope import api, schemas
from kairoscope.operators import evaluate, graph, indexing
from kairoscope.session import session
from kairoscope.sources import media, store


def loaded(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table with the columns of a logical table; those it lacks are null."""
    df = spark.read.parquet(path)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])


def ingest(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Videos and their speech to chunks in a store; vectors where encoders are given."""
    videos = media.durations(read(spark, args.videos, schemas.VIDEOS))
    chunks = api.Engine.chunked(videos, read(spark, args.segments, schemas.SEGMENTS)).join(videos.select("video_id", "source_filename", "video_path"), "video_id")
    frames = F.concat(F.lit(f"{args.frames}/"), "chunk_id", F.lit(".jpg")) if args.frames else F.lit(None).cast("string")
    chunks = chunks.withColumn("frame_path", frames).withColumn("frame_sha256", F.lit(None).cast("string"))
    for column, model in (("visual", args.visual), ("audio", args.audio)):
        vectors = media.embedded(chunks, "transcript", column, (lambda name: lambda: lambda texts: [loaded(name)(t) for t in texts])(model)) if model else chunks.withColumn(column, F.lit(None).cast("array<float>"))
        chunks = vectors if column == "visual" else vectors.withColumn("audio", F.when(F.col("has_audio"), F.col("audio")))
    at = store.ChunkStore(spark, args.store)
    at.replace(store.materialize(chunks, "chunks"))
    return {"videos": at.read().select("video_id").distinct().count(), "chunks": at.read().count()}


def index(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Facts to the graph's tables under a folder."""
    facts = read(spark, args.facts, schemas.FACTS)
    facts = facts.withColumn("fact_key", F.coalesce("fact_key", graph.fact_key(*[F.col(c) for c in graph.FACT])))
    built = api.build_graph(facts)
    for name, df in built.items():
        df.write.mode("overwrite").parquet(f"{args.graph}/{name}")
    return graph.build_counts(facts, built["edges"], built["members"]).first().asDict()


def extract(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A store's chunks to facts by a model, asked only about what is new; how many chunks came from where."""
    chunks = store.ChunkStore(spark, args.store).read()
    chunks = chunks.where(F.col("video_id") == args.video) if args.video else chunks
    how = indexing.index_videos(chunks, args.out, (lambda name: lambda: loaded(name))(args.model), args.model_id, args.prompt_hash, int(args.size or 5))
    return {r["how"]: r["count"] for r in how.groupBy("how").count().collect()}


def migrate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Every chunk with its facts nested, as another graph store takes them."""
    rows = graph.migrated(store.ChunkStore(spark, args.store).read().drop("visual", "audio"), read(spark, args.facts, schemas.FACTS))
    rows.withColumn("point_id", store.point_id(F.col("chunk_id"))).write.mode("overwrite").parquet(args.out)
    return spark.read.parquet(args.out).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("facts")), F.lit(0)).alias("facts")).first().asDict()


def engine(spark: SparkSession, args: argparse.Namespace) -> api.Engine:
    return api.Engine(store.ChunkStore(spark, args.store).read(), loaded(args.visual), loaded(args.audio))


def ask(spark: SparkSession, args: argparse.Namespace) -> dict:
    return engine(spark, args).respond(args.query, args.top_k, args.video or None, args.mode)


def benchmark(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Each query asked once: latencies, and the mean of the best hits' confidence."""
    found = [engine(spark, args).respond(q, args.top_k, None, args.mode) for q in args.query]
    runs = [(x["query_time_ms"], x["results"][0]["confidence_score"] if x["results"] else 0.0) for x in found]
    return evaluate.benchmark_stats(spark.createDataFrame(runs, "latency_ms double, confidence double")).first().asDict()


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kairoscope")
    commands = parser.add_subparsers(dest="command", required=True)
    for call, needed, more in (
        (ingest, ["videos", "segments", "store"], ["frames", "visual", "audio"]), (extract, ["store", "out", "model", "model_id", "prompt_hash"], ["video", "size"]), (index, ["facts", "graph"], []), (migrate, ["store", "facts", "out"], []),
        (ask, ["store", "visual", "audio", "query"], ["video"]), (benchmark, ["store", "visual", "audio"], []),
    ):
        command = commands.add_parser(call.__name__, help=(call.__doc__ or "One query, answered as a service would.").split(".")[0])
        command.set_defaults(call=call)
        for name in needed + more:
            command.add_argument(f"--{name.replace('_', '-')}", required=name in needed, default="")
        if call in (ask, benchmark):
            command.add_argument("--top-k", type=int, default=3)
            command.add_argument("--mode", default="combined", choices=["combined", "visual", "audio", "auto"])
        if call is benchmark:
            command.add_argument("--query", action="append", required=True)
    return parser


def main(given: list[str] | None = None) -> None:
    args = arguments().parse_args(given)
    print(json.dumps(args.call(session(), args), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
