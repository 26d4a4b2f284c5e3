"""Layers derived from raw messages: normalised text, style signals, transcripts."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def build_semantic(messages: DataFrame) -> DataFrame:
    """(message_id, normalized_text, language, token_count, skip_embedding): one projection, no shuffle."""
    clean = messages.select(F.col("id").alias("message_id"), "media_kind", X.normalize_text(F.coalesce("text", F.lit(""))).alias("normalized_text"))
    t = F.col("normalized_text")
    rows = clean.select("message_id", "media_kind", "normalized_text", X.detect_language(t).alias("language"), X.count_fields(t).alias("token_count"))
    # as X.skip_embedding: a blank text has no tokens
    skip = F.coalesce(F.col("media_kind").isin("sticker", "voice", "round"), F.lit(False)) | (F.col("token_count") < 3)
    return rows.select("message_id", "normalized_text", "language", "token_count", skip.alias("skip_embedding"))


def _nonempty(x: Column) -> Column:
    return F.size(x) > 0


def extract_signals(messages: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """(message_id, signal_type, value_json): up to ten rows for each message, of the given kinds alone if any. Id 0 and null ids give none.

    What the kinds left out need is not computed. Sticker use is read from sticker_meta, or from sticker_emoticon where a table has that alone.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    kind = F.coalesce(F.col("media_kind"), F.lit(""))
    found = {"emoji": X.collect_emoji(t), "marks": X.punctuation_counts(t), "runs": X.repeated_chars(t), "slang": X.slang_markers(t), "caps": X.capitalization(t)}
    messages = messages.where(F.col("id") != 0).withColumns({f"sig__{n}": c for n, c in found.items()})  # each is read twice below
    emoji, marks, runs, slang, caps = (F.col(f"sig__{n}") for n in found)
    if "sticker_meta" in messages.columns:
        sticker = F.col("sticker_meta")
    elif "sticker_emoticon" in messages.columns:
        sticker = F.when(F.col("sticker_emoticon").isNotNull(), F.struct(F.lit("").alias("SetName"), F.col("sticker_emoticon").alias("Emoticon")))
    else:
        sticker = F.lit(None).cast("struct<SetName:string,Emoticon:string>")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    signals = {
        "emoji_usage": F.when(_nonempty(emoji), F.to_json(emoji)),
        "emoji_only": F.when(X.is_emoji_only(t) | ((t == "") & (kind == "sticker")), F.lit("true")),
        "punctuation_style": F.when(_nonempty(marks), F.to_json(marks)),
        "capitalization": quoted(caps),
        "length_class": quoted(X.length_class(t)),
        "media_kind": F.when(kind != "", quoted(kind)),
        "sticker_usage": F.when(sticker.isNotNull(), F.to_json(sticker)),
        "repeated_chars": F.when(_nonempty(runs), F.to_json(runs)),
        "slang_markers": F.when(_nonempty(slang), F.to_json(slang)),
        "has_media": F.when(kind != "", F.lit("true")),
    }
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("signal_type"), v.alias("value_json")) for n, v in signals.items() if kinds is None or n in kinds]), lambda s: s["value_json"].isNotNull())
    return messages.select(F.col("id").alias("message_id"), F.inline(rows))


def apply_transcripts(semantic: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts (message_id, transcript, done_at) put into rows not transcribed before; an empty one counts as done."""
    # of several transcripts the latest, of equal times the greatest text
    latest = F.max(F.struct("done_at", F.coalesce("transcript", F.lit("")).alias("text"))).alias("t")
    t = transcripts.groupBy("message_id").agg(latest).select("message_id", F.col("t.text").alias("tr__text"), F.col("t.done_at").alias("tr__at"))
    hit = F.col("transcribed_at").isNull() & F.col("tr__text").isNotNull()
    tokens = X.count_tokens(F.col("tr__text"))
    return (
        semantic.join(t, "message_id", "left")
        .withColumns({
            "normalized_text": F.when(hit, F.col("tr__text")).otherwise(F.col("normalized_text")),
            "token_count": F.when(hit, tokens).otherwise(F.col("token_count")),
            "skip_embedding": F.when(hit, tokens < 3).otherwise(F.col("skip_embedding")),
            "transcribed_at": F.when(hit, F.col("tr__at")).otherwise(F.col("transcribed_at")),
        })
        .select(*semantic.columns)
    )


def pending_transcription(messages: DataFrame, semantic: DataFrame, chats: DataFrame) -> DataFrame:
    """Live in-window voice messages without a transcript, oldest first, with the chat's type."""
    todo = messages.where((F.col("media_kind") == "voice") & F.col("in_memory_window") & ~F.col("is_deleted"))
    open_ = semantic.where(F.col("transcribed_at").isNull()).select(F.col("message_id").alias("id"))
    rows = todo.join(open_, "id").join(chats.select(F.col("id").alias("chat_id"), F.col("type").alias("chat_type")), "chat_id")
    return rows.select("id", "telegram_id", "chat_id", "chat_type", "sent_at").orderBy("sent_at", "id")


def pending_rebuild(messages: DataFrame, semantic: DataFrame) -> DataFrame:
    """Live in-window messages without a semantic row."""
    live = messages.where(F.col("in_memory_window") & ~F.col("is_deleted"))
    return live.join(semantic.select(F.col("message_id").alias("id")), "id", "left_anti")
