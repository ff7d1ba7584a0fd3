"""Logical tables of the engine, as Spark's DDL."""

VIDEOS = "video_id string, source_filename string, video_path string, fps double, total_frames bigint"
SEGMENTS = "video_id string, seg_idx int, start double, `end` double, text string"
CHUNKS = (
    "video_id string, chunk_id string, chunk_index int, start_timestamp double, end_timestamp double, transcript string, "
    "frame_path string, frame_sha256 string, has_audio boolean, video_path string, source_filename string, visual array<float>, audio array<float>"
)
FACTS = "fact_key string, video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string"
CANDIDATES = "video_id string, chunk_id string, subject string, predicate string, object string, evidence string"
ENTITIES = "entity_key string, canonical_name string, aliases array<string>"
EDGES = "edge_key string, video_id string, chunk_id string, start_timestamp double, end_timestamp double, subject_key string, predicate string, predicate_key string, object_key string, evidence string"
COMMUNITIES = "community_id string, level int, parent_id string, member_count bigint, report string, content_hash string"
MEMBERS = "community_id string, level int, entity_key string"
SUMMARIES = "community_id string, content_hash string, model_id string, summary string, updated_at timestamp"
CACHE = (
    "video_id string, chunk_id string, transcript_hash string, model_id string, prompt_hash string, "
    "candidates array<struct<chunk_id:string,subject:string,predicate:string,object:string,evidence:string>>, updated_at timestamp"
)
MENTIONS = "video_id string, chunk_id string, start_timestamp double, name string, entity_type string, confidence double"
QUERIES = "query_id bigint, text string, video_id string, top_k int, visual array<float>, audio array<float>"
STATUS = "video_id string, status string, message string, chunks int, updated_at timestamp"
