"""Temporal windows of media and the interval join from speech segments to windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 5.0, 4.0
#: Intervals of a video, of both sides, up to which they all meet each other; only those of longer videos are cut.
FEW = 64


def chunk_windows(videos: DataFrame, length: float = WINDOW, stride: float = STRIDE) -> DataFrame:
    """videos (video_id, duration) to (video_id, chunk_index, start, end, mid), rounded to two decimals; none for a duration of 0."""
    count = F.ceil(F.col("duration") / stride).cast("int")
    each = videos.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * stride
    end = F.least(start + length, F.col("duration"))
    return each.select("video_id", "chunk_index", F.round(start, 2).alias("start"), F.round(end, 2).alias("end"), F.round((start + end) / 2, 2).alias("mid"))


def readable_windows(windows: DataFrame, readable: DataFrame) -> DataFrame:
    """Windows whose frame can be read (video_id, chunk_index of readable), numbered anew without gaps from 0."""
    from pyspark.sql import Window as W

    kept = windows.join(readable.select("video_id", "chunk_index"), ["video_id", "chunk_index"], "left_semi")
    return kept.withColumn("chunk_index", F.row_number().over(W.partitionBy("video_id").orderBy("start")) - 1)


def interval_join(windows: DataFrame, segments: DataFrame, bucket: float = STRIDE, longest: float | None = None) -> DataFrame:
    """Pairs of a window and a segment (video_id, start, end each) of one video that overlap as open intervals.

    In a video of up to FEW intervals all meet by the video alone, once each. In longer ones they are cut: the later of two
    starts lies in the other interval. So each interval is cut into aligned cells of 1, 2, 4, ...
    buckets of time (at most two a level), and a start goes into the one cell of each level that holds it: one equality
    join on (video, whose cell it is, level, cell) finds every pair once, without a distinct. An interval of n buckets is
    copied at most 2 log2(n) + 1 times, a start once for each level that some interval of the other side may have: for an
    hour's segment 20 instead of 900. The levels are looked up in one pass over the times, those of windows only if the
    caller does not know their `longest` (seconds). A null time or video meets nothing; an interval that ends before it
    starts meets those that hold it.
    """
    w = _placed(windows.withColumnsRenamed({"start": "w_start", "end": "w_end"}), "w", bucket)
    s = _placed(segments.withColumnsRenamed({"start": "s_start", "end": "s_end"}), "s", bucket)
    many = w.select("video_id").unionByName(s.select("video_id")).groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("video_id", F.lit(True).alias("_many"))
    if longest is None and many.isEmpty():  # then no level is looked up
        return w.join(s, "video_id").where("s_end > w_start and s_start < w_end").drop("_w_low", "_w_high", "_s_low", "_s_high")
    w, s = (x.join(many, "video_id", "left") for x in (w, s))
    deepest = lambda df, x: df.where("_many").agg(F.max(_levels(F.col(f"_{x}_low"), F.col(f"_{x}_high")))).first()[0] or 0  # noqa: E731  one number
    # `longest` seconds and the hundredth that rounding may add touch so many buckets and two more
    widest = deepest(w, "w") if longest is None else int(math.log2(math.floor((longest + 0.01) / bucket) + 2))
    of = lambda whose, found: F.transform(found, lambda c: F.struct(F.lit(whose).alias("_whose"), c["level"].alias("_level"), c["cell"].alias("_cell")))
    all_meet = F.array(F.struct(F.lit("all").alias("_whose"), F.lit(0).alias("_level"), F.lit(0).cast("bigint").alias("_cell")))
    cut = lambda x, found: x.select("*", F.inline(F.when(F.col("_many"), found).otherwise(all_meet))).drop("_many")
    below = deepest(s, "s")
    w = cut(w, F.concat(of("w", cells(F.col("_w_low"), F.col("_w_high"))), of("s", holders(F.col("_w_low"), below))))
    s = cut(s, F.concat(of("w", holders(F.col("_s_low"), widest)), of("s", cells(F.col("_s_low"), F.col("_s_high")))))
    met = w.join(s, ["video_id", "_whose", "_level", "_cell"]).where("s_end > w_start and s_start < w_end")
    once = met.where(F.when(F.col("_whose") == "w", F.col("_w_low") <= F.col("_s_low")).when(F.col("_whose") == "s", F.col("_s_low") < F.col("_w_low")).otherwise(True))
    return once.drop("_whose", "_level", "_cell", "_w_low", "_w_high", "_s_low", "_s_high")


def _placed(df: DataFrame, x: str, bucket: float) -> DataFrame:
    """df with the first and the last bucket of its interval."""
    first, last = (F.floor(F.col(f"{x}_{c}") / bucket) for c in ("start", "end"))
    return df.where(F.col(f"{x}_start").isNotNull() & F.col(f"{x}_end").isNotNull()).withColumns({f"_{x}_low": first, f"_{x}_high": F.greatest(first, last)})


def _levels(low: Column, high: Column) -> Column:
    """The largest level of which a cell can lie in the buckets low to high."""
    return F.floor(F.log2(high - low + 1)).cast("int")


def _halved(x: Column, times: Column) -> Column:
    """x over 2^times, rounded down."""
    return F.call_function("shiftright", x, times)


def cells(low: Column, high: Column) -> Column:
    """The aligned cells (level, cell) that the buckets low to high are made of: at level k lie the cells from
    ceil(low / 2^k) to before floor((high + 1) / 2^k), and an odd one at either end is in no larger cell."""

    def ends(k: Column) -> Column:
        a, b = -_halved(-low, k), _halved(high + 1, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        return F.array_compact(F.array(*[F.when((a < b) & odd(end), F.struct(k.alias("level"), cell.alias("cell"))) for end, cell in ((a, a), (b, b - 1))]))

    return F.flatten(F.transform(F.sequence(F.lit(0), _levels(low, high)), ends))


def holders(point: Column, deepest: int) -> Column:
    """The cell of each level up to the deepest that holds a bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda k: F.struct(k.alias("level"), _halved(point, k).alias("cell")))


def window_transcripts(windows: DataFrame, segments: DataFrame, longest: float | None = None) -> DataFrame:
    """Every window with its transcript: texts of overlapping segments in their order, joined by spaces and trimmed."""
    pairs = interval_join(windows, segments.select("video_id", "seg_idx", "start", "end", "text"), longest=longest)
    said = pairs.groupBy("video_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("said"))
    text = F.trim(F.array_join(F.transform("said", lambda s: s["text"]), " "))
    return windows.join(said, ["video_id", "chunk_index"], "left").withColumn("transcript", F.coalesce(text, F.lit(""))).drop("said")


def ingest(windows: DataFrame, segments: DataFrame, longest: float | None = None) -> DataFrame:
    """Chunk rows before vectors: id, times, transcript, whether it has audio. No window is longer than `longest` seconds
    (None: look)."""
    named = window_transcripts(windows, segments, longest)
    return named.select(
        "video_id", F.format_string("%s_chunk_%04d", "video_id", "chunk_index").alias("chunk_id"), "chunk_index",
        F.col("start").alias("start_timestamp"), F.col("end").alias("end_timestamp"), "transcript", (F.length("transcript") > 3).alias("has_audio"),
    )
