"""Episodes: a chat's messages cut where pauses, midnight and reply chains say so.

Whether two neighbours are cut depends on the segment so far (its size, and whether the reply's
target is in it). With the default scores a pause of the hard tier always cuts, whatever was
before; so a chat falls into islands at those pauses, and only islands are scanned one row
after the other. What an island's first segment owes to the island before is settled afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import ORDER, SPAN, bucketed


@dataclass(frozen=True)
class Config:
    hard_gap: int = 4 * 3600
    medium_gap: int = 3600
    soft_gap: int = 20 * 60
    hard_score: float = 0.90
    medium_score: float = 0.48
    soft_score: float = 0.18
    reply_bonus: float = 0.38
    day_multiplier: float = 1.40
    threshold: float = 0.50
    min_size: int = 2
    max_size: int = 60
    #: What reply_to_id names: the message's telegram_id, or its id.
    reply_key: str = "telegram_id"

    @property
    def hard_always_cuts(self) -> bool:
        return np.float32(self.hard_score) - np.float32(self.reply_bonus) >= np.float32(self.threshold)


def unepisoded_messages(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Live in-window messages that are in no episode."""
    live = messages.where(F.col("in_memory_window") & ~F.col("is_deleted"))
    return live.join(links.select(F.col("message_id").alias("id")), "id", "left_anti")


_METHODS = ("", "time_gap_soft", "time_gap_medium", "time_gap_hard", "size_limit", "initial")


def boundary_score(tier: int, midnight: bool, replies_inside: bool, c: Config) -> np.float32:
    """Score of one transition, in 32-bit floats."""
    score = np.float32((0, c.soft_score, c.medium_score, c.hard_score)[tier])
    if replies_inside:
        score = max(np.float32(0), score - np.float32(c.reply_bonus))
    if score > 0 and midnight:
        score = np.float32(min(float(score) * float(np.float32(c.day_multiplier)), 1.0))
    return score


#: Rows of a block of an island.
BLOCK = 1 << 16


def _scan(c: Config):
    scores = [[[boundary_score(t, bool(m), bool(i), c) for i in (0, 1)] for m in (0, 1)] for t in range(4)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by chat and number, blocks whole, with the open size before each block: adds (segment start, method, score).

        The first row of an island, which has no open segment, is a start. What a scan carries from batch to batch is
        the block, the segment's start and its size.
        """
        block, begin, size = None, 0, 0
        for rows in batches:
            n, tier, midnight, reply, opened = (rows[x].tolist() for x in ("n", "tier", "midnight", "reply_n", "opened"))
            keys = list(zip(*(rows[x].tolist() for x in ("chat_id", "island", "block")), strict=True))
            start = np.empty(len(n), np.int64)
            method, score = np.zeros(len(n), np.int8), np.zeros(len(n), np.float32)
            for i in range(len(n)):
                if keys[i] != block:
                    block, begin, size = keys[i], n[i] - opened[i], opened[i]
                if size == 0:
                    size = 1
                else:
                    s, m = scores[tier[i]][midnight[i]][begin <= reply[i] < n[i]], tier[i]
                    if size >= c.max_size:
                        s, m = np.float32(1), 4
                    if s >= np.float32(c.threshold):
                        begin, size, method[i], score[i] = n[i], 1, m, s
                    else:
                        size += 1
                start[i] = begin
            yield rows.drop(columns=["island", "block", "opened"]).assign(segment=start, method=method, score=score)

    return run


def _functions(c: Config):
    cuts = np.array([[[boundary_score(t, bool(m), bool(i), c) >= np.float32(c.threshold) for i in (0, 1)] for m in (0, 1)] for t in range(4)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by chat and number, blocks whole: (chat_id, island, block, after: open size after the block by that before it).

        All sizes before are followed at once; size 0 is an island's beginning.
        """
        block, sizes = None, None
        for rows in batches:
            n, tier, midnight, reply = (rows[x].to_numpy() for x in ("n", "tier", "midnight", "reply_n"))
            keys, done = list(zip(*(rows[x].tolist() for x in ("chat_id", "island", "block")), strict=True)), []
            for i in range(len(n)):
                if keys[i] != block:
                    if block:
                        done.append((*block, sizes.tolist()))
                    block, sizes = keys[i], np.arange(c.max_size + 1)
                # a segment of size s began s rows ago
                inside = (n[i] - sizes <= reply[i]) & (reply[i] < n[i])
                cut = np.where(inside, cuts[tier[i], int(midnight[i]), 1], cuts[tier[i], int(midnight[i]), 0]) | (sizes >= c.max_size) | (sizes == 0)
                sizes = np.where(cut, 1, sizes + 1)
            yield _functions_of(done)
        yield _functions_of([(*block, sizes.tolist())] if block else [])

    return run


def _functions_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chat_id", "island", "block", "after"])


def _with_open_size(rows: DataFrame, c: Config) -> DataFrame:
    """rows (with chat_id, island, n ...) with block and opened, the size of the open segment before the block.

    Only islands of more than one block take the pass for it.
    """
    columns = rows.columns
    rows = rows.withColumn("block", F.expr(f"(n - island) div {BLOCK}"))
    long = rows.groupBy("chat_id", "island").agg(F.max("block").alias("last")).where("last > 0")
    first = rows.join(long, ["chat_id", "island"]).where("block < last").drop("last")
    first = first.repartition("chat_id", "island", "block").sortWithinPartitions("chat_id", "n").select("chat_id", "island", "block", "n", "tier", "midnight", "reply_n")
    functions = first.mapInPandas(_functions(c), "chat_id long, island long, block long, after array<int>")
    # from block to block, beginning with no open segment
    each = functions.groupBy("chat_id", "island").agg(F.array_sort(F.collect_list(F.struct("block", "after"))).alias("f"))
    sizes = F.aggregate("f", F.array(F.lit(0)), lambda known, f: F.concat(known, F.array(F.get(f["after"], F.element_at(known, -1)))))
    opened = each.select("chat_id", "island", F.posexplode(sizes).alias("block", "opened")).withColumn("block", F.col("block").cast("long"))
    return rows.join(opened, ["chat_id", "island", "block"], "left").select(*columns, "block", F.coalesce("opened", F.lit(0)).cast("long").alias("opened"))


def _numbered(messages: DataFrame, hard_us: int | None) -> DataFrame:
    """messages with n (row number in the chat), epi__at (time of the row before) and island (n of its first row).

    Windows run within a day of a chat and over one summary row a day.
    """
    rows = bucketed(messages)
    within = Window.partitionBy("chat_id", SPAN).orderBy(*ORDER)
    rows = rows.withColumns({"epi__at": F.lag("sent_at").over(within), "n": F.row_number().over(within).cast("long")})
    far = lambda a, b: (F.unix_micros(b) - F.unix_micros(a) >= hard_us) if hard_us is not None else F.lit(False)
    days = rows.groupBy("chat_id", SPAN).agg(F.count("*").alias("epi__n"), F.min("sent_at").alias("epi__from"), F.max("sent_at").alias("epi__to"), F.max(F.when(far("epi__at", "sent_at"), F.col("n"))).alias("epi__cut"))
    w = Window.partitionBy("chat_id").orderBy(SPAN)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"epi__low": F.coalesce(F.sum("epi__n").over(past), F.lit(0)), "epi__last": F.lag("epi__to").over(w)})
    first = F.when(F.col("epi__last").isNull() | far("epi__last", "epi__from"), F.col("epi__low") + 1)
    days = days.withColumn("epi__first", first).withColumn("epi__cut", F.coalesce(F.col("epi__cut") + F.col("epi__low"), "epi__first"))
    days = days.select("chat_id", SPAN, "epi__low", "epi__last", F.coalesce("epi__first", F.last("epi__cut", True).over(past)).alias("epi__island"))
    rows = rows.withColumn("island", F.max(F.when(far("epi__at", "sent_at"), F.col("n"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(days, ["chat_id", SPAN])
    low = F.col("epi__low")
    return rows.withColumns({"n": F.col("n") + low, "epi__at": F.coalesce("epi__at", "epi__last"), "island": F.coalesce(F.col("island") + low, "epi__island")}).drop(SPAN, "epi__low", "epi__last", "epi__island")


def segment_episodes(messages: DataFrame, config: Config | None = None) -> DataFrame:
    """messages with segment (row number of its first message), method and confidence, tiny segments merged.

    A lone segment of fewer than min_size messages joins the segment before it; a chat's first
    segment always stays. An island is scanned in blocks of BLOCK rows.
    """
    c = config or Config()
    cols = ("id", "telegram_id", "chat_id", "sender_id", "reply_to_id", "sent_at")
    rows = _numbered(messages.select(*cols), c.hard_gap * 1_000_000 if c.hard_always_cuts else None)
    gap = F.unix_micros("sent_at") - F.unix_micros("epi__at")
    tier = F.when(gap >= c.hard_gap * 1_000_000, 3).when(gap >= c.medium_gap * 1_000_000, 2).when(gap >= c.soft_gap * 1_000_000, 1).otherwise(0)
    rows = rows.withColumns({"tier": tier, "midnight": F.coalesce(~X.same_utc_day(F.col("epi__at"), F.col("sent_at")), F.lit(False))}).drop("epi__at")
    # the row that a message replies to
    targets = rows.select("chat_id", F.col(c.reply_key).alias("reply_to_id"), F.col("n").alias("reply_n")).where("reply_to_id != 0")
    targets = targets.groupBy("chat_id", "reply_to_id").agg(F.max("reply_n").alias("reply_n"))
    rows = rows.join(targets, ["chat_id", "reply_to_id"], "left").withColumn("reply_n", F.coalesce("reply_n", F.lit(-1))).select(*cols, "n", "tier", "midnight", "reply_n", "island")
    ordered = _with_open_size(rows, c).repartition("chat_id", "island", "block").sortWithinPartitions("chat_id", "n")
    types = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "island"} | {"segment": "long", "method": "tinyint", "score": "float"}
    rows = ordered.mapInPandas(_scan(c), ", ".join(f"{n} {t}" for n, t in types.items()))

    # each segment's first row; an island's first looks back at the segment before
    heads = rows.groupBy("chat_id", "segment").agg(F.count("*").alias("size"), F.min_by(F.struct("method", "score", "tier", "midnight", "reply_n"), "n").alias("head"))
    w = Window.partitionBy("chat_id").orderBy("segment")
    heads = heads.withColumns({"before": F.lag("segment").over(w), "before_size": F.lag("size").over(w)})
    inside = F.col("head.reply_n") >= F.col("before")
    back = F.lit(None).cast("float")
    for reply in (False, True):
        for midnight in (False, True):
            back = F.when((inside == reply) & (F.col("head.midnight") == midnight), F.lit(float(boundary_score(3, midnight, reply, c))).cast("float")).otherwise(back)
    full = F.col("before_size") >= c.max_size
    first, island = F.col("before").isNull(), F.col("head.score") == 0
    method = F.when(first, 5).when(island & full, 4).when(island, 3).otherwise(F.col("head.method"))
    score = F.when(first | (island & full), F.lit(1.0).cast("float")).when(island, back).otherwise(F.col("head.score"))
    heads = heads.withColumns({"method": method, "score": score})

    # merge tiny segments into the last one that was kept
    kept = F.when(first | (F.col("size") >= c.min_size), F.struct("segment", "method", "score"))
    heads = heads.withColumn("into", F.last(kept, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = heads.select("chat_id", F.col("segment").alias("epi__segment"), "into")
    names = F.array(*[F.lit(m) for m in _METHODS])
    rows = rows.withColumnRenamed("segment", "epi__segment").join(merged, ["chat_id", "epi__segment"])
    return rows.select(*cols, "n", F.col("into.segment").alias("segment"), F.element_at(names, F.col("into.method") + 1).alias("method"), F.col("into.score").alias("confidence"))


def build_episodes(segmented: DataFrame) -> DataFrame:
    """One row for each segment: key, span, type, participants, method and confidence."""
    replies = F.coalesce("reply_to_id", F.lit(0)) != 0
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000
    e = segmented.groupBy("chat_id", "segment").agg(
        F.min_by("id", "n").alias("episode_id"),
        F.min("sent_at").alias("started_at"),
        F.max("sent_at").alias("ended_at"),
        F.count("*").alias("message_count"),
        F.array_sort(F.collect_set(F.when(F.coalesce("sender_id", F.lit(0)) != 0, F.col("sender_id")))).alias("participant_ids"),
        F.max(replies).alias("has_replies"),
        F.first("method").alias("segmented_by"),
        F.first("confidence").alias("confidence"),
    )
    people = F.size("participant_ids")
    # a chat of one message is a monologue of its own
    alone = (F.col("message_count") == 1) & (F.col("segmented_by") == "initial")
    kind = F.when(alone, "monologue").when(people >= 3, "group").when(people == 1, "monologue").when(seconds > 86_400, "async").when(F.col("has_replies"), "thread")
    kind = kind.when((seconds < 300) & (F.col("message_count") >= 4), "burst").otherwise("dialogue")
    return e.select("episode_id", "chat_id", "started_at", "ended_at", F.round(seconds).cast("int").alias("duration_secs"), kind.alias("episode_type"), "message_count", "participant_ids", "segmented_by", "confidence")


def episode_links(segmented: DataFrame) -> DataFrame:
    """(episode_id, message_id, position from 0); each message is in one episode."""
    first = segmented.where("n = segment").select("chat_id", "segment", F.col("id").alias("episode_id"))
    return segmented.join(first, ["chat_id", "segment"]).select("episode_id", F.col("id").alias("message_id"), (F.col("n") - F.col("segment")).alias("position"))


def episode_docs(links: DataFrame, messages: DataFrame, semantic: DataFrame) -> DataFrame:
    """(episode_id, semantic_text, token_count, skip_embedding): the episode's lines in order."""
    emoticon = F.col("sticker_emoticon") if "sticker_emoticon" in messages.columns else F.col("sticker_meta.Emoticon")
    m = messages.select(F.col("id").alias("message_id"), "is_outgoing", F.coalesce("media_kind", F.lit("")).alias("media_kind"), emoticon.alias("emoticon"))
    rows = links.join(m, "message_id").join(semantic.select("message_id", "normalized_text"), "message_id", "left")
    line = X.episode_line(F.col("is_outgoing"), F.col("media_kind"), F.col("emoticon"), F.coalesce("normalized_text", F.lit("")))
    docs = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("position", line.alias("t"))))).alias("lines"))
    docs = docs.select("episode_id", F.array_join(F.col("lines.t"), "\n").alias("semantic_text"))
    tokens = X.count_tokens(F.col("semantic_text"))
    bare = F.regexp_replace("semantic_text", f"^[{X.WHITE}]+|[{X.WHITE}]+$", "")
    skip = (F.length(bare) < 10) | (tokens < 5)
    return docs.select("episode_id", "semantic_text", tokens.alias("token_count"), skip.alias("skip_embedding"))


def list_episodes(episodes: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Each chat's episodes, newest first."""
    w = Window.partitionBy("chat_id").orderBy(F.col("started_at").desc(), "episode_id")
    return episodes.withColumn("epi__n", F.row_number().over(w)).where((F.col("epi__n") > offset) & (F.col("epi__n") <= offset + limit)).drop("epi__n")
