"""The three workloads: ingest to layers, hybrid retrieval, style and chat reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chats as C
from ..operators import episodes as E
from ..operators import layers, prompts, ranking, reports, sessions, upsert, vectors, windows
from ..sources.scratch import stored


@dataclass
class Memory:
    """The stored tables."""

    chats: DataFrame
    messages: DataFrame
    semantic: DataFrame
    signals: DataFrame
    episodes: DataFrame
    links: DataFrame
    docs: DataFrame


def sync(dialogs: DataFrame, incoming: DataFrame, base: DataFrame, cursors: DataFrame, before: int = windows.BEFORE, after: int = windows.AFTER) -> tuple[Memory, DataFrame]:
    """(memory, cursors) after reading incoming messages: scored chats, upserted messages, layers, windows, episodes.

    Chats, messages, layers and segments are written once, as later steps read them several times. The filter of chats
    would otherwise be pushed into what dialogs are made of, and scores worked out for each row there.
    """
    scored = stored(C.score_chats(dialogs), "chats")
    wanted = incoming.join(C.chats_to_sync(scored).select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    new, marks = upsert.new_since_cursor(wanted, cursors)
    messages = upsert.upsert(base, new, ["chat_id", "telegram_id"], [c for c in upsert.MESSAGE_UPDATES if c in base.columns])
    messages = stored(windows.participation_windows(stored(messages, "raw-messages"), scored, before, after), "messages")
    semantic, signals = stored(layers.build_semantic(messages), "semantic"), stored(layers.extract_signals(messages), "signals")
    segmented = stored(E.segment_episodes(messages.where(F.col("in_memory_window") & ~F.col("is_deleted"))), "segments")
    links = stored(E.episode_links(segmented), "links")
    return Memory(scored, messages, semantic, signals, E.build_episodes(segmented), links, E.episode_docs(links, messages, semantic)), marks


def turns(memory: Memory, gap_seconds: int = sessions.GAP_SECONDS) -> DataFrame:
    return sessions.build_utterances(sessions.utterance_input(memory.messages, memory.semantic, memory.chats), gap_seconds)


def hybrid_retrieval(queries: DataFrame, query_vectors: DataFrame, utterances: DataFrame, store: DataFrame, limit: int = 10) -> DataFrame:
    """Each query's best turns by rank fusion of reranked BM25 and vector search."""

    def scorer(q: DataFrame, u: DataFrame) -> DataFrame:
        return ranking.hybrid_rrf(ranking.bm25_reranked(q, u), vectors.vector_search(query_vectors, store, u))

    return ranking.retrieve(queries, utterances, scorer, limit)


def ask(queries: DataFrame, dialog: DataFrame, utterances: DataFrame, scorer: ranking.Scorer = ranking.bm25_reranked) -> DataFrame:
    """(query_id, prompt) with the person's own turns as memories: 30 are fetched, up to 5 kept."""
    hits = ranking.retrieve(queries, utterances, scorer, limit=30)
    return prompts.build_prompts(queries, ranking.select_memories(hits), dialog)


def style(memory: Memory) -> DataFrame:
    return prompts.style_prompt(reports.style_profile(memory.messages, memory.signals))
