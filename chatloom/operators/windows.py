"""Participation windows: which messages lie near the person's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chats import needs_windowing
from .ordered import near_flag, with_row_number

BEFORE = AFTER = 10


def _numbered(messages: DataFrame) -> DataFrame:
    return with_row_number(messages, "win__n")


def participation_windows(messages: DataFrame, chats: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """messages with in_memory_window set anew in windowed chats.

    A live row is in the window if it lies within `before` rows before or `after` rows after an
    outgoing row, or an outgoing row of the chat replies to it. Deleted rows and other chats
    keep their flag, and so do outgoing rows where it is already true.
    """
    windowed = chats.where(needs_windowing(F.col("personality_surface"))).select(F.col("id").alias("chat_id"))
    live = messages.join(windowed, "chat_id", "left_semi").where(~F.col("is_deleted"))
    near = near_flag(_numbered(live), F.col("is_outgoing"), before, after, "win__near", "win__n")
    targets = live.where(F.col("is_outgoing") & F.col("reply_to_id").isNotNull()).select("chat_id", F.col("reply_to_id").alias("telegram_id")).distinct().withColumn("win__target", F.lit(True))
    flag = F.col("win__near") | F.coalesce("win__target", F.lit(False))
    fresh = near.join(targets, ["chat_id", "telegram_id"], "left").withColumn("in_memory_window", flag | (F.col("is_outgoing") & F.col("in_memory_window")))
    rest = messages.join(windowed, "chat_id", "left_semi").where(F.col("is_deleted")).unionByName(messages.join(windowed, "chat_id", "left_anti"))
    return fresh.select(*messages.columns).unionByName(rest)


def isolated_in_window(messages: DataFrame, reach: int = 10) -> DataFrame:
    """(chat_id, isolated): live in-window incoming rows without an outgoing live row within reach."""
    live = messages.where(~F.col("is_deleted"))
    near = near_flag(_numbered(live), F.col("is_outgoing"), reach, reach, "win__near", "win__n")
    alone = F.col("in_memory_window") & ~F.col("is_outgoing") & ~F.col("win__near")
    return near.groupBy("chat_id").agg(F.count_if(alone).alias("isolated"))


def _around(numbered: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    spots = anchors.select("chat_id", F.col("id").alias("anchor_id"), F.col("win__n").alias("anchor_row"), F.explode(F.sequence(F.col("win__n") - before, F.col("win__n") + after)).alias("win__n"))
    rows = spots.join(numbered, ["chat_id", "win__n"])
    return rows.select("chat_id", "anchor_id", (F.col("win__n") - F.col("anchor_row")).alias("row_offset"), F.col("id").alias("message_id"), "is_outgoing", "text")


def _ranked_anchors(numbered: DataFrame) -> DataFrame:
    return with_row_number(numbered.where("is_outgoing"), "win__rank")


def window_anchors(messages: DataFrame, n: int = 3, before: int = 5, after: int = 5) -> DataFrame:
    """The first n outgoing live rows of each chat with the rows around them."""
    numbered = _numbered(messages.where(~F.col("is_deleted")))
    return _around(numbered, _ranked_anchors(numbered).where(F.col("win__rank") <= n), before, after)


def window_anchors_distributed(messages: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """As window_anchors, for an early, a middle and the last anchor of each chat."""
    numbered = _numbered(messages.where(~F.col("is_deleted")))
    ranked = _ranked_anchors(numbered)
    totals = ranked.groupBy("chat_id").agg(F.count("*").alias("n"))
    early, middle = F.greatest(F.lit(1), F.expr("(n + 9) div 10")), F.greatest(F.lit(1), F.expr("(n + 1) div 2"))
    wanted = totals.select("chat_id", F.explode(F.array_distinct(F.array(early.cast("long"), middle.cast("long"), F.col("n")))).alias("win__rank"))
    return _around(numbered, ranked.join(wanted, ["chat_id", "win__rank"], "left_semi"), before, after)


def window_stats(messages: DataFrame, semantic: DataFrame, chats: DataFrame) -> DataFrame:
    """Per chat with live messages, and in all (chat_id null): total, in_window, anchors, pending rebuild, kept percent."""
    done = semantic.select(F.col("message_id").alias("id"), F.lit(True).alias("win__done"))
    known = messages.where(~F.col("is_deleted")).join(chats.select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    rows = known.join(done, "id", "left").withColumn("win__open", F.col("in_memory_window") & F.col("win__done").isNull())
    out = rows.rollup("chat_id").agg(
        F.count("*").alias("total"), F.count_if("in_memory_window").alias("in_window"), F.count_if("is_outgoing").alias("anchors"), F.count_if("win__open").alias("pending")
    )
    return out.withColumn("kept_pct", 100.0 * F.col("in_window") / F.col("total"))
