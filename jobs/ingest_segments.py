"""Take new speech segments as they arrive and keep the transcripts of all windows up to date.

    python -m jobs.ingest_segments --segments /landing --out /tables/speech --checkpoint /checkpoints/speech [--config other.json]

Each run takes the files under --segments (conversations: conv_id, turn, role, text) that no run before it took, and
stops; Spark's checkpoint knows which. A video is a conversation, a turn its segment. Writes

* <out>/segments, partitioned by bucket (a hash of the video) and batch: segments as they came;
* <out>/chunks, partitioned by bucket: every window of every video with its transcript.

A batch writes its own partitions of segments, then makes the chunks of the buckets it touched anew from all of their
segments, so a batch that is repeated after a failure leaves the same tables. Of several segments with one number in a
video, that of the latest batch counts (in one batch: the one with the greatest text). Settings: `buckets` (at most 1000),
`files_per_batch`, `window` and `stride` in seconds. Segments without a video or a number belong nowhere and are left
out; those without text take their time and say nothing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, settings, started
from kairoscope.operators import windows
from kairoscope.session import session
from kairoscope.streaming import segments as streaming

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
SEGMENTS = "video_id string, seg_idx int, start double, `end` double, text string, bucket int, batch bigint"
CHUNKS = "video_id string, chunk_id string, chunk_index int, start_timestamp double, end_timestamp double, transcript string, has_audio boolean, bucket int"


def segments(conversations: DataFrame, buckets: int) -> DataFrame:
    """Turns as speech of four seconds, three seconds apart, with the bucket of their video."""
    start = 3.0 * F.col("turn")
    rows = conversations.where("conv_id is not null and turn >= 0")
    rows = rows.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), start.alias("start"), (start + 4).alias("end"), "text")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take what is new under source; number of batches, of segments read and of chunks written."""
    config = settings("ingest_segments") | (config or {})
    if not 0 < config["buckets"] <= 1000:
        raise ValueError("buckets must be between 1 and 1000")
    done = {"batches": 0, "segments": 0, "chunks": 0}

    def take(batch: DataFrame, number: int) -> None:
        rows = segments(batch, config["buckets"]).withColumn("batch", F.lit(number))
        put(rows.repartition("bucket"), "bucket", "batch", path=f"{out}/segments")
        here = spark.read.schema(SEGMENTS).parquet(f"{out}/segments").where(F.col("batch") <= number)
        read = {r["bucket"]: r["count"] for r in here.where(F.col("batch") == number).groupBy("bucket").count().collect()}  # at most `buckets`
        touched = F.col("bucket").isin(list(read))
        if read:
            put(chunked(here.where(touched), config).repartition("bucket"), "bucket", path=f"{out}/chunks")
            done["chunks"] += spark.read.schema(CHUNKS).parquet(f"{out}/chunks").where(touched).count()
        done["batches"] += 1
        done["segments"] += sum(read.values())
        log.info("batch %d: read %d segments from %s, made the chunks of %d buckets anew in %s", number, sum(read.values()), source, len(read), out)

    stream = spark.readStream.schema(CONVERSATIONS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(streaming.pattern(source))
    streaming.take(stream, take, checkpoint)
    if not done["chunks"]:
        put(spark.createDataFrame([], CHUNKS), "bucket", path=f"{out}/chunks")  # no partition changes, but there is a table to read
    log.info("read %d segments in %d batches, wrote %d chunks", done["segments"], done["batches"], done["chunks"])
    return done


def put(rows: DataFrame, *by: str, path: str) -> None:
    """Replace the partitions that rows have; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def chunked(found: DataFrame, config: dict) -> DataFrame:
    """The chunks of all segments (SEGMENTS), of each number the one of the last batch."""
    last = F.max_by(F.struct("start", "end", "text"), F.struct("batch", F.coalesce("text", F.lit("")))).alias("last")
    own = found.groupBy("bucket", "video_id", "seg_idx").agg(last).select("bucket", "video_id", "seg_idx", "last.*")
    videos = own.groupBy("video_id", "bucket").agg(F.max("end").alias("duration"))
    made = windows.ingest(windows.chunk_windows(videos, config["window"], config["stride"]), own.drop("bucket"), config["window"])
    return made.join(videos.select("video_id", "bucket"), "video_id")


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks").drop("bucket")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    for name in ("segments", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    asked = parser.parse_args()
    started()
    spark = session("ingest_segments")
    try:
        run(spark, asked.segments, asked.out, asked.checkpoint, settings("ingest_segments", asked.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
