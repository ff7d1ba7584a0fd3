"""Media sources: uploaded files, and model functions as pluggable stages over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.functions.projections import basename
from kairoscope.operators.graph import batches

# File extensions taken as video.
EXTENSIONS = ["mp4", "avi", "mov", "mkv", "webm"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under path, whole; the binary source reads them on executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def content_id(content: Column) -> Column:
    return F.concat(F.lit("video_"), F.substring(F.sha2(content, 256), 1, 16))


def uploads(found: DataFrame) -> DataFrame:
    """(video_id, source_filename, video_path): one row per content, of the first path; other extensions are refused."""
    name = basename(F.col("path"))
    ok = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(EXTENSIONS)
    rows = found.where(ok).select(content_id(F.col("content")).alias("video_id"), name.alias("source_filename"), F.col("path").alias("video_path"))
    return rows.groupBy("video_id").agg(F.min_by("source_filename", "video_path").alias("source_filename"), F.min("video_path").alias("video_path"))


def durations(videos: DataFrame) -> DataFrame:
    """videos (fps, total_frames) with duration; a rate of 0 or less is an error of the source and has none."""
    return videos.withColumn("duration", F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")))


def embedded(df: DataFrame, text: str, vector: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """df with a vector of each text. `model` runs once per worker and returns a function of a batch; short texts give zeros where the model says so."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for series in batches:
            values = series.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in encode(values[i : i + batch])], dtype=object)

    return df.withColumn(vector, run(F.col(text)))


def transcribed(videos: DataFrame, model: Callable[[], Callable[[str], list[tuple[float, float, str]]]]) -> DataFrame:
    """videos (video_id, video_path) to segments; a video whose transcription fails has none, as one without speech."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listen = model()
        for pdf in batches:
            rows = []
            for video, path in zip(pdf.video_id, pdf.video_path):
                try:
                    heard = listen(path)
                except (OSError, RuntimeError):
                    heard = []
                rows += [(video, i, float(a), float(b), t.strip()) for i, (a, b, t) in enumerate(heard)]
            yield pd.DataFrame(rows, columns=["video_id", "seg_idx", "start", "end", "text"])

    return videos.select("video_id", "video_path").mapInPandas(run, "video_id string, seg_idx int, start double, `end` double, text string")


def extracted(chunks: DataFrame, model: Callable[[], Callable[[list[tuple[str, str]]], list[dict]]], size: int = 5) -> DataFrame:
    """chunks (video_id, chunk_id, start_timestamp, transcript) to raw candidates; a call gets `size` chunks of one
    video that follow each other in time. What it says of chunks that it was not given is dropped."""
    fields = ["chunk_id", "subject", "predicate", "object", "evidence"]
    item = F.struct("start_timestamp", "chunk_id", "transcript")
    asked = batches(chunks.select("video_id", "chunk_id", "start_timestamp", "transcript"), size).groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most `size`
    asked = asked.select(F.col("items.chunk_id").alias("ids"), F.col("items.transcript").alias("texts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for pdf in parts:
            found = [c for ids, texts in zip(pdf.ids, pdf.texts) for c in ask(list(zip(ids, texts))) if c.get("chunk_id") in ids]
            yield pd.DataFrame([[c.get(f) for f in fields] for c in found], columns=fields)

    return asked.mapInPandas(run, ", ".join(f"{f} string" for f in fields))


def summarized(reports: DataFrame, model: Callable[[], Callable[[str], str]], most: int = 14_000) -> DataFrame:
    """reports (community_id, content_hash, report) with a summary; models take the first `most` characters."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        write = model()
        for series in batches:
            yield series.map(lambda r: write(r[:most]))

    return reports.withColumn("summary", run(F.col("report")))


def frames(windows: DataFrame, model: Callable[[], Callable[[str, float], bytes | None]]) -> DataFrame:
    """windows (video_path, mid and more) with frame (bytes) and frame_sha256; null where a frame cannot be read."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grab = model()
        for path, mid in batches:
            yield pd.Series([grab(p, float(m)) for p, m in zip(path, mid)], dtype=object)

    return windows.withColumn("frame", run("video_path", "mid")).withColumn("frame_sha256", F.sha2("frame", 256))
