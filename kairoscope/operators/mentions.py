"""The named-entity layer: mentions, co-mention pairs, listings and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import text as T


def entities(mentions: DataFrame) -> DataFrame:
    """(name_key, entity_type, display_name: the longest form, earliest of equals, chunks)."""
    named = mentions.withColumn("name_key", F.lower(T.collapse(F.col("name"))))
    longest = F.max_by("name", F.struct(F.length("name"), -F.col("start_timestamp"), "name"))
    return named.groupBy("name_key", "entity_type").agg(longest.alias("display_name"), F.countDistinct("chunk_id").alias("chunks"))


def co_mentions(mentions: DataFrame) -> DataFrame:
    """(chunk_id, source, target), source < target: distinct pairs of entities of a chunk. A chunk's sorted set of names
    lies in one row; its pairs are made name by name, so that no row holds more of them than there are names."""
    sets = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    each = sets.select("chunk_id", "names", F.posexplode("names").alias("place", "source"))
    return each.select("chunk_id", "source", F.explode(F.slice("names", F.col("place") + 2, F.size("names"))).alias("target"))


def co_mention_weights(mentions: DataFrame) -> DataFrame:
    return co_mentions(mentions).groupBy("source", "target").agg(F.count("*").alias("chunks"))


def summary(mentions: DataFrame) -> DataFrame:
    """One row: entities, mentions, relations."""
    counts = mentions.agg(F.countDistinct(F.lower("name"), "entity_type").alias("entities"), F.count("*").alias("mentions"))
    return counts.crossJoin(co_mentions(mentions).agg(F.count("*").alias("relations")))  # one row each


def search(mentions: DataFrame, terms: Column, k: int) -> DataFrame:
    """Chunks that mention an entity all of whose words are query terms: twice the matched entities, plus the others."""
    words = T.tokens(F.lower("name"))
    hit = (F.length("name") >= 3) & (F.size(words) > 0) & (F.size(F.array_except(words, terms)) == 0)
    per = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.when(hit, F.col("name")))).alias("matched_entities"), F.countDistinct("name").alias("names"), F.min("start_timestamp").alias("start_timestamp"))
    per = per.where(F.size("matched_entities") > 0)
    matched = F.size("matched_entities")
    return per.withColumn("score", 2 * matched + F.greatest(F.lit(0), F.col("names") - matched)).orderBy(F.desc("score"), "start_timestamp", "chunk_id").limit(k)
