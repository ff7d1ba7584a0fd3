"""Shared plumbing of the training-data operators: scratch tables, Arrow batches, word lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kairoscope.sources.store import discard, materialize, scratch_path  # noqa: F401  for all operators here

#: Text bytes that a Python worker holds as Python objects at a time.
SLICE_BYTES = 2 << 20

LETTERS = re.compile(r"[^\W\d_]+")


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table]], schema: StructType | str, text: str | None = "text", slice_bytes: int = SLICE_BYTES, slice_rows: int = 256) -> DataFrame:
    """mapInArrow with each batch cut so that a call sees about slice_bytes of `text`, at least one row, or slice_rows
    rows if text is None.

    `make` runs once per task and returns the function of a slice; a slice is a pyarrow Table with df's columns.
    Between Spark and Python columns go by number, as names may hold dots.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns, names = df.columns, schema.names
    numbered = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).rename_columns(columns)
            edges = cuts(text_lengths(batch.column(columns.index(text))), slice_bytes) if text else [(a, min(a + slice_rows, len(table))) for a in range(0, len(table), slice_rows)]
            for a, b in edges:
                yield from f(table.slice(a, b - a)).rename_columns(numbered).to_batches()

    out = StructType([StructField(n, f.dataType) for n, f in zip(numbered, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, out).toDF(*names)


def named(columns) -> list[Column]:
    """Columns by their exact names, dots and spaces included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def declared(df: DataFrame, added: dict[str, str]) -> StructType:
    """Schema of df's columns and then the added ones."""
    more = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items()))
    return StructType([*[StructField(f.name, f.dataType) for f in df.schema], *more])


def text_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to about `most`."""
    if not len(lengths):
        return []
    part = (np.cumsum(lengths) - lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    return list(zip(edges, edges[1:]))


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n: the published split of rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values[edges[i]:edges[i+1]] along the first axis, empty ranges 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


class Words:
    """Word numbers with one row of scores each, computed once while the word is held.

    `score` maps a list of words to an array [words, k]. The table is emptied when it passes `most` words or
    `most_chars` characters, so memory is bounded whatever the vocabulary.
    """

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int, most: int = 200_000, most_chars: int = 8 << 20):
        self.score, self.width, self.most, self.most_chars = score, width, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((4096, self.width), np.float32)
        self.chars = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.numbers) > self.most or self.chars > self.most_chars:
            self.clear()
        numbers = self.numbers
        before = len(numbers)
        got = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if (n := len(numbers)) > before:
            new = list(numbers)[before:]
            self.chars += sum(map(len, new))
            if n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(n, 2 * len(self.rows)) - len(self.rows), self.width), np.float32)])
            self.rows[before:n] = self.score(new)
        return self.rows[got]


def ngrams(words: list[str], low: int, high: int, bits: int, marks: str = "<>") -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of marked words: (number of the word, bucket), one entry each."""
    text = "".join(f"{marks[0]}{w}{marks[1]}" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
    left = (ends[word] - np.arange(len(points))).astype(np.int32)  # characters from here to the word's end
    hashed, owners, buckets = np.zeros(len(points), np.uint64), [], []
    for n in range(1, high + 1):
        if len(points) < n:
            break
        hashed = hashed[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)
        if n >= low:
            ok = left[: len(hashed)] >= n
            mixed = hashed[ok] * np.uint64(0x9E3779B97F4A7C15)
            owners.append(word[: len(hashed)][ok])
            buckets.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(owners), np.concatenate(buckets)
