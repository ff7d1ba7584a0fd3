"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a 64-bit fingerprint gets a non-zero vector of GF(2)^(r+1). Table v, for each of the 2^(r+1) - 1
non-zero v, keeps the bits whose vector has an odd product with v. Two fingerprints that differ in at most r bits
differ in bits whose vectors span at most r dimensions, so some v is orthogonal to all of them: in that table the
two have the same key. No pair within the radius is missed, whatever the data.

Work is on distinct fingerprints (copies share one) and links are kept as a forest: within a table's bucket a
breadth-first search joins each member once, so a bucket of b members gives at most b - 1 links and not b^2 / 2.
Buckets above BLOCK members are dealt into blocks, and every pair of blocks is searched in its own task, so no
bucket meets in one task and none is cut; a bucket of b distinct fingerprints is copied b / BLOCK times for that.
Components come from alternating large-star and small-star rounds.

Defined results: null or empty text, or text without words, has fingerprint zero and is linked like any other.
A null id keeps its fingerprint and is never a component's name unless all ids of the component are null. Repeated
rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import declared, discard, map_slices, materialize, named, offsets

BLOCK = 4096
#: Rows of one key from which they are joined where they lie, and how many such keys may be broadcast.
HUB, MOST_HUBS = 100_000, 500_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 3, seed: int = 42) -> DataFrame:
    """docs (its columns `keep`, all if None) with fp, the fingerprint's 64 bits as a long."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    docs = docs.select(*named(dict.fromkeys([*kept, text])))

    def make():
        def add(part: pa.Table) -> pa.Table:
            return part.select(kept).append_column("fp", pa.array(simhash(part.column(text).to_pylist(), width, seed).view(np.int64)))

        return add

    return map_slices(docs, make, declared(docs.select(*named(kept)), {"fp": "bigint"}), text)


def simhash(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints: a bit is set if it is in over half of the shingles' XXH64, repeats included."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            continue
        if len(words) <= width:
            shingles = [b" ".join(words)]
        else:
            joined = b" ".join(words)
            start = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()
            shingles = [joined[a:b] for a, b in zip([0, *start], [x - 1 for x in start[width - 1 :]])]
        sizes[i] = len(shingles)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles)))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts)), sizes) * 256
    for k in range(8):
        ones = np.bincount(row + octets[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS
        for b in range(8):
            out |= (2 * ones[:, b] > sizes).astype(np.uint64) << np.uint64(8 * k + b)
    return out


def masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The covering masks, as signed longs. Bit i has the vector 1 + i mod (2^(radius+1) - 1), never zero."""
    n = (1 << (radius + 1)) - 1
    found = [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """prints: distinct fp. Pairs (a, b), a > b, that join what is within `radius` of each other, as forests."""
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius))])).alias("k")).select("k.v", "k.key", "fp")
    buckets = keys.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where("n > 1")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    many = keys.join(buckets.where("n > 2").select("v", "key", "n"), ["v", "key"]).withColumn("s", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    dealt = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    groups = dealt.groupBy("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps")).select("fps")

    def search(batches):
        for batch in batches:
            a, b = [], []
            column = batch.column("fps")
            values, edges = column.flatten().to_numpy(zero_copy_only=False), offsets(column.value_lengths().to_numpy(zero_copy_only=False))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for child, root in forest(values[x:y], radius):
                    a.append(child)
                    b.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], names=["a", "b"])

    return pairs.unionByName(groups.mapInArrow(search, "a bigint, b bigint")).distinct()


def forest(fps: np.ndarray, radius: int):
    """(children, roots) arrays of longs: each member but the smallest of its component within the bucket, and that smallest.

    Breadth first: what a member reaches leaves the rest, so a dense bucket of b members costs about b steps.
    """
    rest = np.unique(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier, reached = [root], []
        while frontier and len(rest):
            near = np.bitwise_count((rest ^ frontier.pop()).view(np.uint64)) <= radius
            if near.any():
                frontier.extend(rest[near])
                reached.append(rest[near])
                rest = rest[~near]
        if reached:
            children = np.concatenate(reached)
            yield children, np.full(len(children), root)


def met(rows: DataFrame, own: DataFrame, key: str, most: int, total: int, hub: int | None = None) -> DataFrame:
    """rows joined with own, which has one row a key and the number of its rows in n; `most` is the largest n, `total` the
    number of rows. Keys of over HUB rows, and of so many that at most MOST_HUBS can be, are broadcast, so that the rows
    of one meet in no task; the others are shuffled."""
    least = max(HUB if hub is None else hub, total // MOST_HUBS)
    if most <= least:
        return rows.join(own.drop("n"), key)
    heavy, rest = own.where(F.col("n") > least).drop("n"), own.where(F.col("n") <= least).drop("n")
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key)
    return far.unionByName(rows.join(F.broadcast(heavy), key))


def components(edges: DataFrame, rounds: int = 40, hub: int | None = None) -> DataFrame:
    """edges (a, b), a > b: (a, root) for every node that is not itself the smallest of its component.

    Alternating stars: each round moves a node's larger neighbours to its smallest one, then its smaller ones.
    Rounds are few (about the logarithm of the longest path); each is written to the shared folder. After `rounds` of
    them without an end (a path of some 2^40 nodes) an error is raised.
    """
    state = materialize(edges, "edges")
    each = lambda x: x.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    size = lambda x: each(x).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("h").alias("h"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    before = size(state)
    for _ in range(rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("bigint")).alias("n"))
        large = met(both.where("v > u"), low, "u", before["most"], before["n"], hub).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = materialize(small, "edges")
        now = size(after)
        discard(state)
        state = after
        if before == now:
            return state.withColumnRenamed("b", "root")
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 3) -> DataFrame:
    """(key, fp, component_id) for each row: component_id is the smallest key reachable by links of at most `radius` bits."""
    prints = materialize(fingerprints(docs.select(key, text), text, [key]), "prints")
    return prints.join(_named(prints, key, radius), "fp", "left").select(key, "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest key, nulls last, and of rows with one key the first stored."""
    # the row's own columns ride in one struct, so that none can clash
    whole = docs.select(F.struct(*named(docs.columns)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialize(fingerprints(whole, keep=["row", "key"]).withColumn("serial", F.monotonically_increasing_id()), "printed")
    prints = rows.select(F.struct(F.col("key").isNull().alias("no"), "key", "serial").alias("place"), "fp")
    first = _named(prints, "place", radius).select(F.col("component_id.serial").alias("serial")).distinct()
    return rows.join(first, "serial", "left_semi").select("row").select("row.*")


def _named(prints: DataFrame, key: str, radius: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(links(distinct.select("fp"), radius))
    own = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return own.join(own.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
