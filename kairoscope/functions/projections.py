"""Projections of chunks for results."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def frame_url(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("/frames/"), basename(path))).otherwise(F.lit(""))


def snippet(transcript: Column, length: int = 200) -> Column:
    return F.substring(transcript, 1, length)


def audible(transcript: Column, vector: Column) -> Column:
    """The audio vector, kept only for transcripts of over three characters."""
    return F.when(F.length(F.trim(transcript)) > 3, vector)


def response(confidence: Column, text_match: Column, visual: Column | None = None, audio: Column | None = None, coverage: Column | None = None) -> Column:
    """A result with all fields that the service sends, of a chunk's columns. Similarities are null in modes that have
    none; the share of the query's words is 0 there."""
    none = F.lit(None).cast("double")
    return F.struct(
        "start_timestamp", "end_timestamp", confidence.alias("confidence_score"), "video_id", frame_url(F.col("frame_path")).alias("frame_url"),
        snippet(F.col("transcript")).alias("transcript_snippet"), visual.alias("visual_similarity") if visual is not None else none.alias("visual_similarity"),
        audio.alias("audio_similarity") if audio is not None else none.alias("audio_similarity"), text_match.alias("text_match"), (F.lit(0.0) if coverage is None else F.coalesce(coverage, F.lit(0.0))).alias("text_coverage"),
    )
