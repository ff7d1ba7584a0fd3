"""The engine's calls: listing, search in all modes, graph answers, ingestion. Each returns a DataFrame unless told otherwise.

Encoders are functions of a text to a vector on the driver, one query at a time; they stand outside the engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairoscope.functions import text as T
from kairoscope.functions.projections import frame_url, snippet
from kairoscope.operators import answer, communities, graph, search, windows
from kairoscope.operators.token_index import TokenIndex
from kairoscope.sources import store
from kairoscope.sources.store import materialize

Encoder = Callable[[str], list[float]]
# What an answer says when there is no evidence, and before quotes where the model cited nothing.
NO_EVIDENCE = "لم أجد في الفهرس الحالي أدلة كافية للإجابة عن هذا السؤال."
SCORE_TYPE = "retrieval_rank_not_confidence"
# Why a mode was taken, as responses say it.
REASONS = {
    ("combined", True): "الاستعلام يطلب الصورة والصوت معًا",
    ("visual", True): "ظهرت كلمات تشير إلى صورة أو مشهد",
    ("audio", True): "ظهرت كلمات تشير إلى كلام أو صوت منطوق",
    ("combined", False): "الاستعلام غير صريح؛ استُخدم البحث المختلط لتغطية الصورة والصوت",
    ("audio", False): "كلمات الاستعلام تطابق نصًا موجودًا في التفريغ الصوتي",
}
UNCITED = "لم يقدّم النموذج إجابة بصيغة استشهاد قابلة للتحقق. هذه أقرب الأدلة المسترجعة؛ راجع نص كل مقطع وتوقيته قبل اعتمادها:"


def checked(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {low} to {high}" if high else f"{name} must be at least {low}")
    return value


@dataclass
class Engine:
    """chunks: the chunk table with vectors. The graph tables may be missing; graph calls then have nothing to find."""

    chunks: DataFrame
    encode_visual: Encoder
    encode_text: Encoder
    edges: DataFrame | None = None
    entities: DataFrame | None = None
    members: DataFrame | None = None
    reports: DataFrame | None = None
    status: dict[str, str] = field(default_factory=dict)
    index: TokenIndex | None = None  # of the chunks' transcripts; without one, lexical search reads them all

    def _scope(self, video_id: str | None) -> DataFrame:
        return self.chunks if not video_id else self.chunks.where(F.col("video_id") == video_id)

    # search

    def ranked(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        """Fused hits after suppression of overlaps, all columns."""
        checked("top_k", top_k, 1, 20)
        rows = self._scope(video_id)
        asked = search.understood(rows.sparkSession, query)
        hits = search.hybrid(rows, self.encode_visual(asked.stripped), self.encode_text(asked.stripped), asked.stripped, top_k, asked.v_weight, asked.a_weight)
        payload = rows.drop("visual", "audio")
        kept = search.deduplicated(hits.join(payload, "chunk_id"), top_k, asked.visual_focused).select("chunk_id", "text_match", "joint_score")
        return payload.join(F.broadcast(kept), "chunk_id").orderBy(F.desc("text_match"), F.desc("joint_score"), "chunk_id")  # at most top_k rows

    def search(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        return self.ranked(query, top_k, video_id).select("start_timestamp", "end_timestamp", F.col("joint_score").alias("confidence_score"))

    def preview(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        return self.ranked(query, top_k, video_id).select("chunk_id", "video_id", "start_timestamp", "end_timestamp", F.col("joint_score").alias("confidence_score"), "text_match", frame_url(F.col("frame_path")).alias("frame_url"), snippet(F.col("transcript")).alias("snippet"))

    def visual_preview(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        return search.visual_search(self._scope(video_id), self.encode_visual(query), checked("top_k", top_k, 1, 20))

    def audio_preview(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        return search.audio_search(self._scope(video_id), self.encode_text(query), query, checked("top_k", top_k, 1, 20), self.index)

    def mode_of(self, query: str, video_id: str | None = None) -> tuple[str, bool]:
        """The mode that auto_preview takes, and whether the query's own words say so."""
        asked = search.understood(self.chunks.sparkSession, query)
        if asked.explicit:
            return asked.intent, True
        best = search.lexical(self._scope(video_id), query, self.index).agg(F.coalesce(F.max("coverage"), F.lit(0.0))).first()[0]
        return ("audio" if best >= search.NEAR_COVERAGE else asked.intent), False

    def auto_preview(self, query: str, top_k: int = 3, video_id: str | None = None) -> DataFrame:
        return self._calls()[self.mode_of(query, video_id)[0]](query, top_k, video_id)

    def _calls(self) -> dict:
        return {"visual": self.visual_preview, "audio": self.audio_preview, "combined": self.preview}

    def respond(self, query: str, top_k: int = 3, video_id: str | None = None, mode: str = "combined") -> dict:
        """{results, query_time_ms, total_chunks_searched} as a service sends them; mode "auto" also says which mode was
        taken and why."""
        began, more = time.perf_counter(), {}
        if mode == "auto":
            mode, explicit = self.mode_of(query, video_id)
            kind = {"visual": "visual_similarity", "audio": "audio_similarity"}.get(mode, "joint")
            more = {"detected_intent": mode, "intent_reason": REASONS[mode, explicit], "score_type": kind}
        if mode not in self._calls():
            raise ValueError("mode must be 'combined', 'visual', 'audio' or 'auto'")
        found = self._calls()[mode](query, top_k, video_id)
        score = F.col("confidence_score") if "confidence_score" in found.columns else F.col("confidence")
        matched = F.col("text_match") if "text_match" in found.columns else F.lit(False)
        order = [F.desc(c) for c in ("text_match", "rank_score", "confidence_score", "confidence") if c in found.columns]
        own = lambda c, kind: F.col(c) if c in found.columns else F.lit(None).cast(kind)
        more_fields = own("visual_similarity", "double").alias("visual_similarity"), own("audio_similarity", "double").alias("audio_similarity"), matched.alias("text_match"), F.coalesce(own("coverage", "double"), F.lit(0.0)).alias("text_coverage")
        rows = found.orderBy(*order, "chunk_id").select("start_timestamp", "end_timestamp", score.alias("confidence_score"), "video_id", "frame_url", F.col("snippet").alias("transcript_snippet"), *more_fields)
        results = [r.asDict() for r in rows.collect()]  # at most top_k
        return {"results": results, "query_time_ms": round((time.perf_counter() - began) * 1000, 2), "total_chunks_searched": self.chunks.count(), **more}

    def graph_preview(self, query: str, top_k: int = 5, video_id: str | None = None) -> DataFrame:
        terms = self._terms(query)
        edges = self.edges if not video_id else self.edges.where(F.col("video_id") == video_id)
        return graph.fact_search(edges, F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), checked("top_k", top_k, 1, 20))

    def _terms(self, query: str) -> list[str]:
        one = self.chunks.sparkSession.createDataFrame([(query,)], "t string")
        return one.select(T.query_terms(T.normalize_entity(F.col("t")))).first()[0]

    # answers

    def sources(self, query: str, mode: str = "local", top_k: int = 5, video_id: str | None = None, **tables) -> DataFrame:
        """Numbered sources of an answer, as gathered() finds them."""
        return self.gathered(query, mode, top_k, video_id, **tables)[0]

    def gathered(self, query: str, mode: str = "local", top_k: int = 5, video_id: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, entity_vectors: DataFrame | None = None, report_vectors: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
        """(numbered sources, names of the entities matched, ids of the communities chosen). embed adds `embedding` to
        facts; entity_vectors and report_vectors are the entities and reports with theirs. Without them the answer rests
        on transcripts. A video limits transcripts, facts and communities alike."""
        if mode not in ("local", "global"):
            raise ValueError("mode must be 'local' or 'global'")
        if not query:
            raise ValueError("an empty question")
        checked("top_k", top_k, 1, 10)
        rows, vector = self._scope(video_id), self.encode_text(query)
        is_list = rows.sparkSession.range(1).select(T.is_list_question(F.lit(query))).first()[0]
        hits = answer.best_per_chunk(rows, [self.encode_text(q) for q in answer.expanded(query, is_list)], top_k)
        position = lambda df, order: df.withColumn("position", F.row_number().over(W.orderBy(*order)))  # noqa: E731  over few rows
        said = position(hits, [F.desc("sim"), "best_rank", "chunk_id"]).withColumn("frame_url", frame_url(F.col("frame_path")))
        base = ["position", "chunk_id", "video_id", "start_timestamp", "end_timestamp"]
        facts = rows.sparkSession.createDataFrame([], "position int, chunk_id string, video_id string, start_timestamp double, end_timestamp double, subject string, predicate string, object string, evidence string")
        asked = self._terms(query)
        terms = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
        matched, chosen_ids, found = [], [], None
        if self.edges is not None and embed and mode == "local" and entity_vectors is not None:
            edges = self.edges if not video_id else self.edges.where(F.col("video_id") == video_id)
            anchors = materialize(answer.anchors(entity_vectors, vector, terms), "anchors")
            matched = [r["canonical_name"] for r in anchors.orderBy(F.desc("score"), "entity_key").collect()]  # five
            found = answer.local_context(edges, graph.named_edges(edges, self.entities), anchors, vector, terms, top_k, embed)
        if self.edges is not None and embed and mode == "global" and report_vectors is not None:
            in_scope = communities.in_scope(report_vectors, self.members, self.edges, video_id or None)
            chosen = materialize(answer.ranked_communities(in_scope, vector, top_k), "chosen")
            chosen_ids = [r["community_id"] for r in chosen.orderBy(F.desc("score"), "community_id").select("community_id").collect()]  # top_k
            found = answer.global_context(graph.named_edges(self.edges, self.entities), self.members, chosen, vector, terms, top_k, embed, video_id)
        if found is not None:
            facts = position(found, [F.desc("score"), "edge_key"]).select(*base, "subject", "predicate", "object", "evidence")
        return answer.sources(said.select(*base, "transcript", "frame_url"), facts, top_k, bool(is_list)), matched, chosen_ids

    def graph_answer(self, query: str, generate: Callable[[str, list[dict]], str] | None = None, mode: str = "local", **settings) -> dict:
        """{query, mode, answer, citations, matched_entities, community_ids, score_type, sources}. generate writes a text
        that cites sources; an answer without a valid citation gives way to the first sources, quoted."""
        df, matched, chosen = self.gathered(query, mode, **settings)
        found = [r.asDict() for r in df.orderBy(F.substring("citation_id", 2, 9).cast("int")).collect()]  # at most ten
        cited, text = [], NO_EVIDENCE
        if found:
            text = generate(query, found).strip() if generate else ""
            ids = F.array(*[F.lit(s["citation_id"]) for s in found])
            cited = self.chunks.sparkSession.range(1).select(T.citations(F.lit(text), ids)).first()[0]
            if not text or not cited:
                cited = [s["citation_id"] for s in found[:3]]
                text = UNCITED + "\n" + "\n\n".join(f"[{s['citation_id']}] {s['content'][:900]}" for s in found[:3])
        fields = ("citation_id", "chunk_id", "video_id", "start_timestamp", "end_timestamp", "frame_url")
        citations = [{f: s[f] for f in fields} | {"evidence": s["content"]} for s in found if s["citation_id"] in cited]
        return {"query": query, "mode": mode, "answer": text, "citations": citations, "matched_entities": matched, "community_ids": chosen, "score_type": SCORE_TYPE, "sources": found}

    # listings

    def about(self) -> dict:
        """What a service says of itself: calls, vector sizes, which tables it has."""
        sizes = self.chunks.select(F.max(F.size("visual")), F.max(F.size("audio"))).first()
        tables = [t for t in ("edges", "entities", "members", "reports") if getattr(self, t) is not None]
        return {"modes": [*self._calls(), "auto"], "visual_dimensions": sizes[0], "audio_dimensions": sizes[1], "graph_tables": tables, "ready": True}

    def videos(self) -> DataFrame:
        return store.video_listing(self.chunks)

    def list_entities(self) -> DataFrame:
        return graph.entity_catalog(self.entities)

    def list_communities(self, level: int | None = None, video_id: str | None = None) -> DataFrame:
        if level is not None:
            checked("level", level, 0)
        return communities.in_scope(self.reports, self.members, self.edges, video_id, level)

    # ingestion

    @staticmethod
    def chunked(videos: DataFrame, segments: DataFrame) -> DataFrame:
        """videos (video_id, duration) and their speech to chunk rows before vectors."""
        return windows.ingest(windows.chunk_windows(videos), segments, windows.WINDOW)

    def begin(self, video_id: str) -> None:
        """Mark a video as being ingested; a second upload of it meanwhile is refused."""
        if self.status.get(video_id) == "processing":
            raise ValueError(f"{video_id} is being ingested")
        self.status[video_id] = "processing"

    def end(self, video_id: str, error: str = "") -> None:
        self.status[video_id] = f"failed: {error}" if error else "done"


def build_graph(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts (video_id, chunk_id, times, subject, predicate, object, evidence, fact_key) to all graph tables; facts,
    edges and levels are written once, as several tables rest on them."""
    keyed = materialize(graph.keyed_facts(facts), "facts")
    edges, entities = materialize(graph.fact_edges(keyed), "edges"), materialize(graph.resolved_entities(keyed), "entities")
    members = materialize(communities.identified(communities.detect(graph.edge_weights(edges), entities.select("entity_key"))), "members")
    named = graph.named_edges(edges, entities)
    return {"edges": edges, "entities": entities, "members": members, "parents": communities.parents(members), "reports": communities.reports(members, named, entities)}
