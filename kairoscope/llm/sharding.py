"""Sharding by sampled splitters.

A weighted sample of keys gives quantile splitters, which range-partition the records; ranges that turn out overfull
are sampled again, more densely, and subdivided, until none is. A record weighs by its share of all bytes and of all
records, so neither long texts nor a host of empty ones make a range too large for a task. Exact sizes of the ranges
then place every record: a record's shard is where its cumulated size lies, so shards are consecutive key ranges whose
sizes differ by about one record, whatever the sample was. Only the sample, the splitters and one row per range come
to the driver; all three have fixed bounds.

The key is (hash of the text, id, serial): equal texts lie next to each other, and a group of copies larger than a
range is still split, by id and by serial.

Defined results: a null text has size 1 and a null hash, a null id sorts first, repeated rows are told apart by a
serial. An empty table gives an empty result; with fewer records than shards some shards are empty. Other columns
ride along, whatever their names; only shard and slot are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairoscope.llm.common import materialize, named

#: Ranges of the first round: one for every ROWS_EACH records within these bounds; the sample has SAMPLES_EACH keys for each.
RANGES, MOST_RANGES, ROWS_EACH, SAMPLES_EACH = 128, 8192, 500_000, 32
#: Rounds of subdivision; each cuts an overfull range into pieces of half a range and less, as far as a sample can tell.
ROUNDS = 6


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(key, size, text_crc32, h): all that sharding needs of a record; and the columns `keep`, if any."""
    t = F.col(text)
    added = [F.col(key), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).alias("text_crc32"), F.when(t.isNotNull(), F.xxhash64(t)).alias("h")]
    return docs.select(*added, *named(c for c in keep or [] if c not in (key, "size", "text_crc32", "h")))


def shard(records: DataFrame, shards: int = 8, key: str = "doc_id", ranges: int | None = None, overfull: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """records (key, size, h and more) with shard (0 to shards - 1, sizes near equal) and slot (gapless from 0 in a shard)."""
    plain = [c for c in records.columns if c not in ("shard", "slot")]
    row = F.struct(*named(plain)).alias("row")  # so that no name clashes
    held = materialize(records.select(row, F.col(key).alias("k"), "size", "h", F.monotonically_increasing_id().alias("serial")), "records")
    total, count = held.agg(F.sum("size"), F.count("*")).first()
    if not total:
        return held.select("row.*", F.lit(0).cast("int").alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ranges = ranges or min(MOST_RANGES, max(RANGES, count // ROWS_EACH))
    kind = held.schema["k"].dataType.simpleString()
    splitters = quantiles(held, _weight(total, count), ranges * SAMPLES_EACH, ranges)
    for r in range(rounds + 1):
        placed = held.withColumn("range", located(_place(), splitters, kind))
        exact = {r["range"]: (r["size"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        # in units of an average range
        load = {k: (size / total + n / count) / 2 * ranges for k, (size, n) in exact.items()}
        full = [k for k, x in load.items() if x > overfull and exact[k][1] > 1]
        if not full or r == rounds:
            break
        pieces = sum(int(2 * load[k]) + 1 for k in full)
        more = quantiles(placed.where(F.col("range").isin(full)), _weight(total, count), pieces * SAMPLES_EACH, pieces)
        finer = sorted({*splitters, *more}, key=_order)
        if finer == splitters:
            break
        splitters = finer
    before, at, bases = 0, 0, []
    for r in range(len(splitters) + 1):
        bases.append((before, at))
        before, at = before + exact.get(r, (0, 0))[0], at + exact.get(r, (0, 0))[1]
    inside = W.partitionBy("range").orderBy("h", "k", "serial").rowsBetween(W.unboundedPreceding, -1)
    base, rank = (F.get(_literal([b[i] for b in bases], "bigint"), F.col("range")) for i in (0, 1))
    put = placed.withColumn("before", base + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("rank", rank + F.count("*").over(inside))
    # a record goes where its middle lies
    put = put.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((before * 2 + size) * {shards} div {2 * total} as int)")))
    put = materialize(put.select("row", "shard", "rank"), "shards")
    least = {r["shard"]: r["low"] for r in put.groupBy("shard").agg(F.min("rank").alias("low")).collect()}
    start = _literal([least.get(s, 0) for s in range(shards)], "bigint")
    return put.select("row.*", "shard", (F.col("rank") - F.get(start, F.col("shard"))).alias("slot"))


def _weight(total: int, count: int) -> Column:
    """A record's share of all bytes and of all records."""
    return F.col("size") / float(total) + F.lit(1.0 / count)


def quantiles(records: DataFrame, weight: Column, samples: int, ranges: int) -> list[tuple]:
    """Splitters from a weighted sample without replacement: the keys with the largest u^(1/weight) for u by a hash of the key."""
    place = _place()
    u = (F.pmod(F.xxhash64(F.lit("sample"), place), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sample = sorted((tuple(r["p"]) for r in records.select(place.alias("p"), (F.log(u) / weight).alias("w")).orderBy(F.desc("w")).limit(samples).collect()), key=_order)
    picked = {sample[len(sample) * i // ranges] for i in range(1, ranges)} if len(sample) > 1 else set()
    return sorted(picked, key=_order)


def _place() -> Column:
    return F.struct("h", "k", "serial")


def _literal(values: list, kind: str) -> Column:
    """An array as one literal, however long; an expression for each element would make the plan as long."""
    return F.from_json(F.lit(json.dumps(values, default=str)), f"array<{kind}>")


def _order(place: tuple) -> tuple:
    return tuple((x is not None, 0 if x is None else x) for x in place)


def located(place: Column, splitters: list[tuple], kind: str = "bigint") -> Column:
    """How many splitters are at most the key: a binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    held = _literal([dict(zip(("h", "k", "serial"), s)) for s in splitters], f"struct<h:bigint,k:{kind},serial:bigint>")
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, F.least(at + step, F.lit(n)) - 1) <= place), at + step).otherwise(at))
