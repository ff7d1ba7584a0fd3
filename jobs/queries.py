"""The jobs as registered queries: each runs twice into a new folder of its own and returns what then lies there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import ingest_segments, token_index
from kairoscope.plans.catalogue import SEGMENTS, WINDOWS, token_list
from kairoscope.sources.store import shared_folder


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"  # stays


def job1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        token_index.run(spark, f"{sf_dir}/documents.parquet", out)
    return token_index.output(spark, out)


def job2_ingest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        ingest_segments.run(spark, f"{sf_dir}/conversations.parquet", f"{out}/tables", f"{out}/checkpoint")
    return ingest_segments.output(spark, f"{out}/tables").withColumn("transcript", F.md5("transcript"))


QUERIES = {f.__name__: f for f in (job1_token_index, job2_ingest_segments)}

ORACLE_SQL = {
    "job1_token_index": f"""WITH p AS (SELECT DISTINCT 'c' || doc_id AS chunk_id, unnest({token_list("text")}) AS token FROM documents),
v AS (SELECT DISTINCT 'c' || doc_id AS chunk_id, source AS video_id FROM documents)
SELECT 'postings' AS part, token, chunk_id, NULL::VARCHAR AS video_id, 1::BIGINT AS chunks FROM p
UNION ALL SELECT 'vocabulary', token, NULL, NULL, count(*) FROM p GROUP BY token
UNION ALL SELECT 'videos', token, NULL, video_id, count(*) FROM p JOIN v USING (chunk_id) GROUP BY token, video_id""",
    "job2_ingest_segments": f"""WITH {SEGMENTS}, {WINDOWS}, said AS (SELECT w.video_id, w.chunk_index, string_agg(g.text, ' ' ORDER BY g.seg_idx, g.text) AS t FROM windows w JOIN segments g ON g.video_id = w.video_id AND g.e > w.s AND g.s < w.e GROUP BY ALL)
SELECT video_id, printf('%s_chunk_%04d', video_id, chunk_index) AS chunk_id, chunk_index, round(s, 2) AS start_timestamp, round(e, 2) AS end_timestamp, md5(trim(coalesce(t, ''))) AS transcript, length(trim(coalesce(t, ''))) > 3 AS has_audio FROM windows LEFT JOIN said USING (video_id, chunk_index)""",
}
