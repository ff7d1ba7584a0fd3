"""Best-fit packing with certified bin counts.

Documents become token pieces of at most CAPACITY; pieces are dealt into partitions of bounded size and each is
packed by best-fit decreasing. Dual-feasible functions give a lower bound of each partition's bins: a partition that
meets its bound is certified optimal and done. Partitions with a gap give up the documents of their bins that are
not full; a few such partitions pool theirs and run best-fit decreasing again, which is kept where it saves a bin.

Defined results: null or empty text is the separator alone, one piece of one token. Only longer documents are cut,
their first piece takes the remainder. Every row gets pieces, repeated rows and null ids too. Pieces of one id may
meet more than once if ids repeat; sequences stay right. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.bpe import load_ranks, loaded
from kairoscope.llm.common import declared, map_slices, materialize, named

CAPACITY = 2048


class Encoder:
    """Ids of a `tokenizers` file's byte-level BPE, computed by its rank file; the file itself serves texts that
    hold the string of a special token, which it alone treats as one."""

    def __init__(self, path: str, ranks: str, pattern: str, specials: tuple[str, ...] = ("<|endoftext|>",)):
        self.path, self.ranks, self.specials = path, ranks, specials
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
        self.file = None

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials):
            if self.file is None:
                from tokenizers import Tokenizer

                self.file = Tokenizer.from_file(self.path)
            return np.array(self.file.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its regex gives up on very long runs of white space; the scan doesn't
            return np.array(loaded(self.ranks).encode([text])[0], np.uint32)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*settings) -> Encoder:
    if settings not in _ENCODERS:
        _ENCODERS[settings] = Encoder(*settings)
    return _ENCODERS[settings]


def pieces(docs: DataFrame, settings: tuple, text: str = "text", key: str = "doc_id", separator: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document: ids, then the separator, cut into pieces.

    settings: path of the tokenizers file, path of its ranks, split pattern.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        encode = encoder(*settings)

        def cut(part: pa.Table) -> pa.Table:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(part.column(text).to_pylist()):
                ids = np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(separator))
                first = len(ids) % capacity or capacity
                for k, low in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[low : first if not k else low + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(low)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            return pa.table([part.column(key).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

        return cut

    return map_slices(docs.select(key, text), make, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", text)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: largest first, into the fullest bin that takes it. Bins are held by free room, which is an integer."""
    out = np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r free
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, count
            count += 1
        out[i] = bin_
        left = room - size
        if left:
            open_bins[left].append(bin_)
            rooms |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, most: int = 40) -> int:
    """The best of the dual-feasible functions u(k) (rounding down to multiples of 1/k) and of the thresholds t
    (above capacity - t counts whole, below t not at all)."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    above, mass = np.cumsum(n[::-1])[::-1], np.cumsum(n * size)
    t = np.arange(1, capacity // 2 + 1)
    whole = np.append(above, 0)[capacity - t + 1]
    best = max(best, int((-(-(whole * capacity + mass[capacity - t] - mass[t - 1]) // capacity)).max()))
    for k in range(1, most + 1):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY, part_rows: int = 20_000, pool: int = 4, rounds: int = 3) -> DataFrame:
    """cut (any columns, with length) with sequence_id, offset, and part, bins, bound: the certificate of the partition
    that packed the piece last (bins = bound: proven optimal for its pieces)."""
    plain = [c for c in cut.columns if c not in _ADDED]
    cut = materialize(cut.select(*named(plain)), "pieces")
    parts = max(1, -(-cut.count() // part_rows))
    schema = declared(cut, _ADDED)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))

    def first(table: pa.Table) -> pa.Table:
        return _packed(table, plain, capacity, best_fit_decreasing(table.column("length").to_numpy(), capacity))

    state = materialize(dealt.groupBy("part").applyInArrow(first, schema), "packed")
    for k in range(rounds if parts > 1 else 0):
        gaps = state.where("bins > bound").select("part").distinct()
        pools = -(-gaps.count() // pool)
        if not pools:
            break

        def again(table: pa.Table) -> pa.Table:
            bins = np.stack([table.column("origin").to_numpy(), table.column("bin").to_numpy()])
            old = np.unique(bins, axis=1, return_inverse=True)[1].ravel()
            new = best_fit_decreasing(table.column("length").to_numpy(), capacity)
            return _packed(table, plain, capacity, new if new.max() < old.max() else old)

        # pools are drawn by hash; a gap partition moves what lies in bins with room and keeps its full bins
        pooled = F.pmod(F.xxhash64(F.lit(k), "origin"), F.lit(pools)) + F.lit((k + 1) << 32)
        moving = state.join(gaps, "part", "left_semi").where("room > 0").withColumnRenamed("part", "origin").withColumn("part", pooled)
        moved = moving.select(*named(plain), "part", "origin", "bin").groupBy("part").applyInArrow(again, schema)
        marked = state.join(gaps.withColumn("gap", F.lit(True)), "part", "left")
        still = marked.where("gap is null or room = 0").withColumn("bins", F.when(F.col("gap"), F.col("bound")).otherwise(F.col("bins")))
        state = materialize(still.select(*named(moved.columns)).unionByName(moved), "packed")
    return state.select(*named(plain), (F.col("part") * (1 << 22) + F.col("bin")).alias("sequence_id"), "offset", "part", "bins", "bound")


_ADDED = {"part": "bigint", "bin": "bigint", "offset": "bigint", "room": "bigint", "bins": "bigint", "bound": "bigint"}


def _packed(table: pa.Table, plain: list[str], capacity: int, bin_: np.ndarray) -> pa.Table:
    sizes = table.column("length").to_numpy()
    bins = int(bin_.max()) + 1
    fill = np.bincount(bin_, sizes, bins).astype(np.int64)
    order = np.argsort(bin_, kind="stable")
    offset = np.empty(len(sizes), np.int64)
    offset[order] = np.cumsum(sizes[order]) - sizes[order] - (np.cumsum(fill) - fill)[bin_[order]]
    columns = [bin_.astype(np.int64), offset, capacity - fill[bin_], np.full(len(sizes), bins), np.full(len(sizes), lower_bound(sizes, capacity))]
    return pa.table([*[table.column(c) for c in [*plain, "part"]], *map(pa.array, columns)], names=[*plain, *_ADDED])
