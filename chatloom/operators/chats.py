"""Chat scoring and message filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (type, condition) -> score, surface; the reasons are this library's own words. Creators are tried before admins.
SCORES = (
    ("saved_messages", None, 1.00, "self_expression", "what the owner keeps for later"),
    ("private", "is_bot", 0.50, "tool_interaction", "a bot: shows which services are used, and how"),
    ("private", None, 0.85, "interpersonal", "two people talking: most of what is said is about them"),
    ("group", "is_creator", 0.80, "social", "the owner founded this group"),
    ("group", "is_admin", 0.70, "social", "the owner looks after this group"),
    ("group", None, 0.60, "social", "one of a group"),
    ("supergroup", "is_creator", 0.75, "social", "the owner founded this large group"),
    ("supergroup", "is_admin", 0.65, "social", "the owner looks after this large group"),
    ("supergroup", None, 0.55, "social", "one of a large group"),
    ("channel", "is_creator", 0.90, "self_expression", "the owner's own channel: written for an audience"),
    ("channel", "is_admin", 0.75, "self_expression", "a channel that the owner helps to write"),
    ("channel", None, 0.10, "passive_consumption", "a channel that the owner only reads"),
)
SYNC_THRESHOLD = 0.35
WINDOWED_SURFACES = ("social", "passive_consumption")


def score_chats(chats: DataFrame) -> DataFrame:
    """chats with relevance_score (float), relevance_reason and personality_surface."""
    unknown = F.concat(F.lit("no rule for type '"), F.coalesce("type", F.lit("")), F.lit("'"))
    score, surface, reason = F.lit(0.0), F.lit("passive_consumption"), unknown
    for kind, flag, points, where, why in reversed(SCORES):
        hit = F.col("type") == kind
        if flag:
            hit &= F.coalesce(F.col(flag), F.lit(False))
        score, surface, reason = F.when(hit, points).otherwise(score), F.when(hit, where).otherwise(surface), F.when(hit, why).otherwise(reason)
    return chats.withColumns({"relevance_score": score.cast("float"), "relevance_reason": reason, "personality_surface": surface})


def chats_to_sync(scored: DataFrame, threshold: float = SYNC_THRESHOLD) -> DataFrame:
    return scored.where(F.col("relevance_score") >= F.lit(threshold).cast("float"))


def needs_windowing(surface: Column) -> Column:
    return surface.isin(*WINDOWED_SURFACES)


def surface_summary(scored: DataFrame, threshold: float = SYNC_THRESHOLD) -> DataFrame:
    """Chats of each surface: all, to sync, excluded."""
    sync = F.col("relevance_score") >= F.lit(threshold).cast("float")
    return scored.groupBy("personality_surface").agg(F.count("*").alias("chats"), F.count_if(sync).alias("to_sync"), F.count_if(~sync).alias("excluded"))


def list_chats(chats: DataFrame) -> DataFrame:
    return chats.orderBy(F.col("updated_at").desc_nulls_last(), "id")


def message_filter(*, chat_id: int | None = None, surface: str | None = None, outgoing: bool | None = None, media_kind: str | None = None, since=None, until=None) -> Column:
    """Predicate over messages (with personality_surface joined where a surface is asked for)."""
    ok = F.col("in_memory_window")
    for name, value in (("chat_id", chat_id), ("personality_surface", surface), ("is_outgoing", outgoing), ("media_kind", media_kind)):
        if value is not None:
            ok &= F.col(name) == value
    if since is not None:
        ok &= F.col("sent_at") >= F.lit(since)
    if until is not None:
        ok &= F.col("sent_at") <= F.lit(until)
    return ok


def with_chat(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """messages with chat_title and personality_surface (inner join)."""
    return messages.join(chats.select(F.col("id").alias("chat_id"), F.col("title").alias("chat_title"), "personality_surface"), "chat_id")


def with_episode(messages: DataFrame, links: DataFrame) -> DataFrame:
    """messages with episode_id, 0 where there is none."""
    own = links.select(F.col("message_id").alias("id"), "episode_id")
    return messages.join(own, "id", "left").withColumn("episode_id", F.coalesce("episode_id", F.lit(0)))


_HIT = ("id", "chat_id", "chat_title", "personality_surface", "text", "is_outgoing", "sent_at", "episode_id", "rank", "match_type")


def filter_messages(messages: DataFrame, chats: DataFrame, links: DataFrame, limit: int = 20, **conditions) -> DataFrame:
    """Search by metadata alone: newest first, rank 0, match_type `filter`."""
    rows = with_chat(messages.where(~F.col("is_deleted")), chats).where(message_filter(**conditions))
    top = rows.orderBy(F.col("sent_at").desc(), F.col("id").desc()).limit(limit)
    return with_episode(top, links).select(*_HIT[:-2], F.lit(0.0).alias("rank"), F.lit("filter").alias("match_type"))


def list_messages(messages: DataFrame, *, chat_id=None, sender_id=None, since=None, until=None, outgoing=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Live messages, newest first. A limit outside 1..1000 becomes 100."""
    rows = messages.where(~F.col("is_deleted"))
    for name, value in (("chat_id", chat_id), ("sender_id", sender_id), ("is_outgoing", outgoing)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col("sent_at") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("sent_at") <= F.lit(until))
    return rows.orderBy(F.col("sent_at").desc(), F.col("id").desc()).offset(offset).limit(limit if 1 <= limit <= 1000 else 100)
