"""Token counts by separator scan over flat, unindexed token streams.

A stream is what a writer leaves behind: ids of document after document, each closed by the end-of-document id,
cut into blocks of a fixed number of ids with no regard to documents and no index. Counting reads blocks in any
order and on any executor: separators are found by one vectorised comparison per block, which yields their places
and the block's length. A prefix scan over the blocks' lengths and last separators then stitches boundaries: it
gives every block its place in the stream and the start of the document that is still open when it begins.

The prefix scan has two levels, so that no stream meets in one task: blocks are scanned within chunks of CHUNK
blocks, chunks within their stream.

Defined results: a null or empty text is a document of 0 tokens, its separator alone. Ids after the last separator
are an unfinished document, reported only if asked for. An empty table gives an empty result; an empty block counts
nothing. Repeated rows are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairoscope.llm.common import SLICE_BYTES, cuts, text_lengths
from kairoscope.llm.packing import encoder

BLOCK_IDS = 1 << 16
CHUNK = 4096


def narrowed(ids: np.ndarray, separator: int) -> np.ndarray:
    """ids as 16-bit numbers; an error if one does not fit, or is the separator."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids of a stream have 16 bits")
    if (ids == separator).any():
        raise ValueError("a text's ids hold the separator")
    return ids.astype("<u2")


def write_streams(docs: DataFrame, path: str, settings: tuple, text: str = "text", key: str = "doc_id", separator: int = 50256, block: int = BLOCK_IDS) -> None:
    """One stream per task, as Parquet under path: kind=ids (stream, block, ids: little-endian 16-bit numbers) and
    kind=names (stream, doc_no, key), which says which document was written when and nothing of its place."""
    if separator >= 1 << 16:
        raise ValueError("ids of a stream have 16 bits")
    docs = docs.select(key, text)
    name = docs.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder(*settings)
        stream, number, at = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def blocks(last: bool):
            nonlocal held, size, number
            whole = np.concatenate(held) if held else np.zeros(0, "<u2")
            n = len(whole) if last else len(whole) // block * block
            parts = [whole[i : min(i + block, n)].tobytes() for i in range(0, n, block)]
            held, size = [whole[n:]], len(whole) - n
            if parts:
                m = len(parts)
                yield pa.RecordBatch.from_pydict({"kind": ["ids"] * m, "stream": [stream] * m, "n": list(range(number, number + m)), "ids": parts, key: pa.nulls(m, kind)}, schema)
                number += m

        schema, kind = None, None
        for batch in batches:
            if schema is None:
                kind = batch.column(0).type
                schema = pa.schema([("kind", pa.string()), ("stream", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), (key, kind)])
            for low, high in cuts(text_lengths(batch.column(1)), SLICE_BYTES):
                for t in batch.column(1).slice(low, high - low).to_pylist():
                    ids = narrowed(encode(t), separator) if t else np.zeros(0, "<u2")
                    held += [ids, np.array([separator], "<u2")]
                    size += len(ids) + 1
                n = high - low
                yield pa.RecordBatch.from_pydict({"kind": ["names"] * n, "stream": [stream] * n, "n": list(range(at, at + n)), "ids": pa.nulls(n, pa.binary()), key: batch.column(0).slice(low, n)}, schema)
                at += n
                if size >= block:
                    yield from blocks(False)
        if schema is not None:
            yield from blocks(True)

    docs.mapInArrow(run, f"kind string, stream int, n bigint, ids binary, `{key}` {name}").write.partitionBy("kind").option("compression", "zstd").parquet(path)


def separators(blocks: DataFrame, separator: int = 50256) -> DataFrame:
    """(stream, block, length, places): where the separator stands in each block of (stream, n, ids)."""

    def run(batches):
        for batch in batches:
            edges = batch.column(2)
            length, places = [], []
            for raw in edges:
                ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", "<u2")
                length.append(len(ids))
                places.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["stream", "block", "length", "places"])

    return blocks.select("stream", "n", "ids").mapInArrow(run, "stream int, block bigint, length bigint, places array<int>")


def stitched(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(stream, doc_no, start, n_tokens) of each document closed by a separator, in the order of its stream."""
    blocks = found.withColumn("chunk", F.expr(f"block div {chunk}"))
    row = blocks.select("stream", "chunk", "block", "length", "places", F.size("places").cast("bigint").alias("n"))
    inside = W.partitionBy("stream", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    end = F.when(F.col("n") > 0, F.col("base") + F.element_at("places", -1) + 1)
    row = row.withColumn("base", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn("docs", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("end", end)
    row = row.withColumn("open", F.last("end", True).over(inside))
    chunks = row.groupBy("stream", "chunk").agg(F.sum("length").alias("c_length"), F.sum("n").alias("c_docs"), F.max("end").alias("c_end"))
    whole = W.partitionBy("stream").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("c_base", F.coalesce(F.sum("c_length").over(whole), F.lit(0))).withColumn("c_first", F.coalesce(F.sum("c_docs").over(whole), F.lit(0)))
    chunks = chunks.withColumn("c_open", F.coalesce(F.last(F.col("c_base") + F.col("c_end"), True).over(whole), F.lit(0)))
    joined = row.where("n > 0").join(chunks.select("stream", "chunk", "c_base", "c_first", "c_open"), ["stream", "chunk"])
    start = F.coalesce(F.col("c_base") + F.col("open"), F.col("c_open"))
    each = joined.select("stream", (F.col("c_base") + F.col("base")).alias("at"), (F.col("c_first") + F.col("docs")).alias("first"), start.alias("open"), "places")
    each = each.select("stream", "first", "open", F.transform("places", lambda p: p + F.col("at")).alias("seps"))
    each = each.select("stream", "first", F.posexplode(F.transform("seps", lambda s, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.get("seps", i - 1) + 1).alias("start"), s.alias("stop")))).alias("i", "d"))
    return each.select("stream", (F.col("first") + F.col("i")).alias("doc_no"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def token_counts(spark, path: str, key: str = "doc_id", separator: int = 50256, kind: str = "bigint") -> DataFrame:
    """(key, stream, doc_no, start, n_tokens) of the documents in streams written to path; start: ids before it in its
    stream. kind: type of the key, as an empty folder does not tell."""
    stored = spark.read.schema(f"stream int, n bigint, ids binary, `{key}` {kind}, kind string").parquet(path)
    counts = stitched(separators(stored.where("kind = 'ids'"), separator))
    names = stored.where("kind = 'names'").select("stream", F.col("n").alias("doc_no"), key)
    return names.join(counts, ["stream", "doc_no"]).select(key, "stream", "doc_no", "start", "n_tokens")
