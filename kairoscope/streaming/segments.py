"""Streaming ingestion: event-time windows over segments, de-duplication, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairoscope.sources.store import discard, materialize, remove, upserted


def sliding_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "5 minutes", stride: str = "4 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value per key and sliding window; on a stream, rows later than `late` are given up."""
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    w = stream.groupBy(F.window(ts, length, stride), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    w = stream.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("s_start"), F.col("session_window.end").alias("s_end"), key, "n")


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their key; state is kept for the watermark only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def segments_in_windows(windows: DataFrame, segments: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Pairs of a window (video_id, chunk_index, w_start, w_end) and a segment (video_id, seg_idx, s_start, s_end) of one
    video that overlap as open intervals, all four timestamps. Of two streams each waits for the other: state is kept
    until the watermark has passed what a window or segment could still meet."""
    if windows.isStreaming:
        windows = windows.withWatermark("w_start", late)
    if segments.isStreaming:
        segments = segments.withWatermark("s_start", late)
    # the bounds on starts follow from the lengths and let old state go; they leave out no pair of at most `late`
    near = F.expr(f"w_start < s_start + interval {late} and s_start < w_start + interval {late}")
    pairs = windows.alias("w").join(segments.alias("s"), (F.col("w.video_id") == F.col("s.video_id")) & near & (F.col("s_end") > F.col("w_start")) & (F.col("s_start") < F.col("w_end")))
    return pairs.select("w.video_id", "chunk_index", "seg_idx", "w_start", "s_start")


def pattern(path: str) -> str:
    """The path as a pattern that matches just it: a stream reads a folder by its name, but one file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files at path, a folder or one file, as a stream; times without a zone are in the session's, as
    watermarks need one."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern(path))
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in stream.schema if f.dataType.typeName() == "timestamp_ntz"})


def take(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand what is new in the stream to apply(batch, number), batch by batch, and return when there is no more."""
    query = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a keyed table under path up to date. Of several rows of a key in a batch, the
    last by `order` stays.

    The table lies in buckets by a hash of the key, each in numbered versions (path/v=<batch>/bucket=<n>). A batch
    rewrites only the buckets that it touches; of each it then keeps the version before, which a repeated batch starts
    from, and deletes older ones. So a restart leaves the same table, and space stays within two versions.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = materialize(batch.withColumn("bucket", bucket), "batch")
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}  # at most `buckets`
        if not touched:
            return
        before = _read(spark, path, {b: v for b, v in _newest(spark, path, number).items() if b in touched}, batch.schema)
        after = upserted(before, rows.select(*before.columns), keys, [F.desc(c) for c in order])
        # a static overwrite leaves the marker in the version's folder, whatever the session's mode is
        after.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/v={number}")
        discard(rows)
        previous = _newest(spark, path, number)
        for v, b in _versions(spark, path):
            if b in touched and v < previous.get(b, v):
                remove(spark, f"{path}/v={v}/bucket={b}")

    return apply


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upsert_into() keeps under path; empty if there is none yet."""
    return _read(spark, path, _newest(spark, path), schema)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(version, bucket) of every folder under path whose version was written to its end, as Spark's marker says: what a
    batch that died left behind is not read."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = {str(s.getPath().getParent()) for s in fs.globStatus(jvm_path(jvm_path(path), "v=*/_SUCCESS")) or []}
    found = [s for s in fs.globStatus(jvm_path(jvm_path(path), "v=*/bucket=*")) or [] if str(s.getPath().getParent()) in whole]
    return [tuple(int(part.rpartition("=")[2]) for part in str(s.getPath()).split("/")[-2:]) for s in found]


def _newest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, older than batch `below` if that is given."""
    out: dict[int, int] = {}
    for v, b in _versions(spark, path):
        if below is None or v < below:
            out[b] = max(v, out.get(b, v))
    return out


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/v={v}/bucket={b}" for b, v in sorted(versions.items())])
