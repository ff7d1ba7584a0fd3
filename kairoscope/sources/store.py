"""The chunk store and keyed tables: Parquet with upserts by key and replacement by partition."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kairoscope.functions.projections import basename
from kairoscope.functions.text import casefold


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where it is unset and everything runs on this machine does a
    temporary one take its place: on a cluster nobody else could read what an executor writes there."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kairoscope-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch tables that df reads directly; call it once nothing else needs them."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if any(path.endswith(p.rpartition("/")[2]) for _, p in _made):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first
            return


def upserted(table: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """table with rows of `new` in place of those with the same key; of several new rows the last in order stays."""
    if order:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Cascade: rows that do not refer to keys."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def replaced(table: DataFrame, new: DataFrame, videos: DataFrame, on: str = "video_id") -> DataFrame:
    """All rows of the videos out, the new ones in: dependants of a video go with it."""
    return without(table, videos, [on]).unionByName(new.join(videos.select(on).distinct(), on, "left_semi"))


def kept_only(table: DataFrame, keep: DataFrame, on: str = "video_id") -> DataFrame:
    return table.join(keep.select(on).distinct(), on, "left_semi")


def stale(table: DataFrame, keep: DataFrame, on: str = "video_id") -> DataFrame:
    """Sorted keys in the table that are not to be kept."""
    return table.select(on).distinct().join(keep.select(on), on, "left_anti").orderBy(on)


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities at no end of any edge."""
    ends = edges.select(F.explode(F.array("subject_key", "object_key")).alias("entity_key")).distinct()
    return entities.join(ends, "entity_key", "left_anti")


def transcripts(chunks: DataFrame, video_id: str | None = None) -> DataFrame:
    """All payload without vectors; the partition column prunes files."""
    rows = chunks.drop("visual", "audio")
    return rows if not video_id else rows.where(F.col("video_id") == video_id)


#: Rows of a page of a scroll.
PAGE = 256


def scroll(chunks: DataFrame, after: tuple[str, int] | None = None, video_id: str | None = None, size: int = PAGE) -> DataFrame:
    """The next page in order of (video_id, chunk_index), without vectors: the first `size` rows beyond the key of the
    last row seen. The key is two plain comparisons on columns, so a table that lies sorted is read from there on only;
    no row is skipped over, however deep the page."""
    rows = transcripts(chunks, video_id)
    if after:
        video, index = after
        beyond = (F.col("video_id") > video) | ((F.col("video_id") == video) & (F.col("chunk_index") > index))
        rows = rows.where(F.col("video_id") >= video).where(beyond)
    return rows.orderBy("video_id", "chunk_index").limit(size)


def write_sorted(chunks: DataFrame, path: str) -> None:
    """chunks under path in ranges of (video_id, chunk_index), sorted within files, so that a scroll prunes by statistics;
    a video with very many chunks is many files, one with few shares a file with others."""
    chunks.repartitionByRange("video_id", "chunk_index").sortWithinPartitions("video_id", "chunk_index").write.mode("overwrite").parquet(path)


def pages(chunks: DataFrame, size: int = PAGE) -> DataFrame:
    """chunks with page (from 0) and place (from 0) of each row in the scroll of all, in order of (video_id, chunk_index);
    repeated keys in any order, rows without one left out. Ranges are sorted and numbered each on its own and the counts of those before added: no
    window over all rows, and none over a video."""
    keyed = chunks.where("video_id is not null and chunk_index is not null")
    ranged = keyed.repartitionByRange("video_id", "chunk_index").sortWithinPartitions("video_id", "chunk_index")
    # the number holds the partition in its upper bits and the place in it in the lower 33
    written = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "pages")
    part = F.shiftright("_id", 33)
    counts = written.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    numbered = written.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumns({"page": F.floor(place / size), "place": place % size}).drop("_part", "_before", "_id")


def video_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("video_id").distinct().orderBy("video_id")


def display_name(filename: Column, path: Column, video_id: Column) -> Column:
    return F.coalesce(F.nullif(filename, F.lit("")), F.nullif(basename(path), F.lit("")), video_id)


def video_listing(chunks: DataFrame) -> DataFrame:
    """(video_id, filename, chunks) by the last chunk of each video, in order of name and id."""
    name = display_name(F.col("source_filename"), F.col("video_path"), F.col("video_id"))
    listed = chunks.groupBy("video_id").agg(F.max_by(name, "chunk_index").alias("filename"), F.count("*").alias("chunks"))
    return listed.orderBy(casefold(F.col("filename")), "video_id")


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("video_id").agg(F.count("*").alias("chunks")).orderBy("video_id")


def cache_hits(chunks: DataFrame, cache: DataFrame, model_id: str, prompt_hash: str) -> DataFrame:
    """chunks (video_id, chunk_id, transcript) with the candidates cached for just this transcript, model and prompt; null for a miss."""
    own = cache.where((F.col("model_id") == model_id) & (F.col("prompt_hash") == prompt_hash)).select("video_id", "chunk_id", "transcript_hash", "candidates", F.lit(True).alias("hit"))
    hashed = chunks.withColumn("transcript_hash", F.sha2("transcript", 256))
    return hashed.join(own, ["video_id", "chunk_id", "transcript_hash"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def reusable_facts(chunks: DataFrame, stored: DataFrame, facts: DataFrame, runs: DataFrame, model_id: str, prompt_hash: str) -> DataFrame:
    """Facts of chunks whose stored transcript is unchanged and that this model and prompt (runs: chunk_id, model_id,
    prompt_hash) extracted before."""
    same = chunks.join(stored.select("chunk_id", F.col("transcript").alias("_old")), "chunk_id").where(F.col("transcript") == F.col("_old"))
    made = runs.where((F.col("model_id") == model_id) & (F.col("prompt_hash") == prompt_hash))
    return facts.join(same.select("chunk_id"), "chunk_id", "left_semi").join(made.select("chunk_id"), "chunk_id", "left_semi")


class ChunkStore:
    """Chunks in a folder, partitioned by video: replacing a video replaces its partition and nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, None

    def read(self) -> DataFrame:
        found = self.spark.read.schema(self.schema).parquet(self.path) if self.schema else self.spark.read.parquet(self.path)
        schema = StructType([StructField(f.name, StringType() if f.name == "video_id" else f.dataType) for f in found.schema])  # "007" is no number
        return self.spark.read.schema(schema).parquet(self.path)

    def replace(self, chunks: DataFrame) -> None:
        """Write chunks; partitions of their videos are replaced, each as a whole."""
        self.schema = chunks.schema  # a store without a chunk has no file to tell it
        chunks.repartition("video_id", F.floor(F.col("chunk_index") / 10_000)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(self.path)

    def delete(self, video_id: str) -> int:
        """Remove a video's partition; how many chunks it had."""
        n = self.read().where(F.col("video_id") == video_id).count()
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(video_id)  # as the writer names folders
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = jvm_path(jvm_path(self.path), f"video_id={escaped}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return n


# Fixed value: the namespace of URLs, in which ids of points are made.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The name-based UUID (version 5) of a chunk's id: the key under which stores upsert its point."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    # the thirteenth digit is the version, the top two bits of the seventeenth the variant
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
