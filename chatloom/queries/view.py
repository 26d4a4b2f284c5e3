"""A chat log made of the tables `events` and `documents`, alike in Spark and in SQL.

Every event is a message. Every document is dealt, whole, among the messages that carry text and
belong to it (event_id modulo the range of doc_id), in even consecutive pieces. The Spark side is
written once for each session and folder and read back by every query.

Episodes of the view are runs of 25 message numbers, so that reports over episodes have a twin
in SQL; real segmentation has queries of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chats, episodes, layers, postings, sessions
from ..operators.ordered import with_row_number
from ..sources.scratch import stored

EMOJI_CLASS = f"[{X.EMOJI_BLOCKS}{X.JOINERS}]"
STRIP_CLASS = rf"[{X.EMOJI_BLOCKS}\x{{200D}}\x{{FE00}}-\x{{FE0F}}]"
WHITE_CLASS = f"[{X.WHITE}]+"
_SLANG = ", ".join(f"'{w}'" for w in X.SLANG)

_PARTS = """
e AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(floor(user_id / 15) AS BIGINT) + 1 AS chat_id
  FROM events),
m AS (
  SELECT *, CAST(floor(us / 7200000000) AS BIGINT) * 7200000000 + CAST(floor((us % 7200000000) / 20) AS BIGINT) AS sent_us,
         CASE WHEN k % 10 = 0 THEN 'sticker' WHEN k % 10 = 1 THEN 'voice'
              WHEN k % 20 = 2 THEN 'photo' WHEN k % 20 = 12 THEN 'round' ELSE '' END AS media_kind,
         user_id % 15 < 4 AS is_outgoing
  FROM e),
NUMBERED,
dealt AS (
  SELECT event_id, event_id % docs AS doc_id, row_number() OVER (PARTITION BY event_id % docs ORDER BY event_id) - 1 AS piece, count(*) OVER (PARTITION BY event_id % docs) AS pieces
  FROM m, (SELECT coalesce(max(doc_id), 0) + 1 AS docs FROM documents) r WHERE media_kind NOT IN ('sticker', 'voice', 'round')),
pieces AS (
  SELECT event_id, substr(text, CAST(a + 1 AS INT), CAST(b - a AS INT)) AS text FROM (
    SELECT p.event_id, d.text, floor(length(d.text) * piece / pieces) AS a, floor(length(d.text) * (piece + 1) / pieces) AS b FROM dealt p JOIN documents d ON d.doc_id = p.doc_id) c),
messages AS (
  SELECT n.event_id + 1 AS id, n.telegram_id, n.chat_id,
         CASE WHEN n.is_outgoing THEN CAST(1000000 AS BIGINT) ELSE n.user_id + 1 END AS sender_id,
         CASE WHEN n.k % 3 = 0 AND n.telegram_id > 1 + n.k % 5 THEN n.telegram_id - 1 - n.k % 5 END AS reply_to_id,
         CASE WHEN n.media_kind IN ('sticker', 'voice', 'round') THEN ''
              ELSE concat(coalesce(p.text, ''),
                          CASE WHEN n.k % 5 = 3 THEN ' 😂😂' ELSE '' END, CASE WHEN n.k % 7 = 3 THEN ' Ок, ну' ELSE '' END,
                          CASE WHEN n.k % 11 = 3 THEN ' !!!' ELSE '' END, CASE WHEN n.k % 13 = 3 THEN ' аааа...' ELSE '' END) END AS text,
         n.media_kind,
         CASE WHEN n.media_kind <> 'sticker' THEN NULL WHEN n.k % 40 = 0 THEN '' WHEN n.k % 20 = 0 THEN '😂' ELSE '👍' END AS sticker_emoticon,
         n.sent_us, n.is_outgoing, n.k % 23 = 5 AS is_deleted, n.k % 17 = 4 AS is_forwarded,
         CASE WHEN n.k % 19 = 4 THEN n.sent_us + 60000000 END AS edit_us, n.telegram_id % 9 <> 4 AS in_memory_window
  FROM n LEFT JOIN pieces p ON p.event_id = n.event_id),
dialogs AS (
  SELECT chat_id AS id, concat('chat-', CAST(chat_id AS VARCHAR)) AS title,
         CASE chat_id % 5 WHEN 0 THEN 'saved_messages' WHEN 1 THEN 'private' WHEN 2 THEN 'group' WHEN 3 THEN 'supergroup' ELSE 'channel' END AS type,
         chat_id % 10 = 6 AS is_bot, chat_id % 10 IN (2, 4) AS is_creator, chat_id % 10 IN (3, 7) AS is_admin
  FROM (SELECT DISTINCT CAST(floor(user_id / 15) AS BIGINT) + 1 AS chat_id FROM events) c
  UNION ALL SELECT 900000005, 'chat-empty', 'saved_messages', FALSE, FALSE, FALSE)"""

_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY sent_us, event_id) AS telegram_id FROM m)"

_DUCK = f"""
chats AS (
  SELECT *, CAST(CASE type WHEN 'saved_messages' THEN 1.0 WHEN 'private' THEN CASE WHEN is_bot THEN 0.5 ELSE 0.85 END
    WHEN 'group' THEN CASE WHEN is_creator THEN 0.8 WHEN is_admin THEN 0.7 ELSE 0.6 END
    WHEN 'supergroup' THEN CASE WHEN is_creator THEN 0.75 WHEN is_admin THEN 0.65 ELSE 0.55 END
    WHEN 'channel' THEN CASE WHEN is_creator THEN 0.9 WHEN is_admin THEN 0.75 ELSE 0.1 END ELSE 0.0 END AS DOUBLE) AS relevance_score,
  CASE WHEN type = 'saved_messages' OR (type = 'channel' AND (is_creator OR is_admin)) THEN 'self_expression'
    WHEN type = 'private' AND is_bot THEN 'tool_interaction' WHEN type = 'private' THEN 'interpersonal'
    WHEN type IN ('group', 'supergroup') THEN 'social' ELSE 'passive_consumption' END AS personality_surface
  FROM dialogs),
norm AS (
  SELECT id AS message_id, media_kind, trim(regexp_replace(lower(regexp_replace(text, '{STRIP_CLASS}', ' ', 'g')), '{WHITE_CLASS}', ' ', 'g'), ' ') AS normalized_text FROM messages),
semantic AS (
  SELECT message_id, normalized_text,
    CASE WHEN regexp_matches(normalized_text, '\\p{{Cyrillic}}') AND regexp_matches(normalized_text, '[a-z]') THEN 'mixed'
         WHEN regexp_matches(normalized_text, '\\p{{Cyrillic}}') THEN 'ru' WHEN regexp_matches(normalized_text, '[a-z]') THEN 'en' END AS language,
    CAST(CASE WHEN normalized_text = '' THEN 0 ELSE len(string_split(normalized_text, ' ')) END AS BIGINT) AS token_count, media_kind FROM norm),
links AS (
  SELECT id AS message_id, chat_id * 1000000 + telegram_id // 25 AS episode_id, chat_id, telegram_id, sent_us FROM messages WHERE in_memory_window AND NOT is_deleted),
episodes AS (
  SELECT episode_id, chat_id, count(*) AS message_count, min(sent_us) AS started_us FROM links GROUP BY episode_id, chat_id),
items AS (
  SELECT id AS message_id, 'emoji_usage' AS signal_type, unnest(regexp_extract_all(text, '{EMOJI_CLASS}')) AS item FROM messages
  UNION ALL
  SELECT message_id, 'slang_markers', unnest(list_distinct(list_filter(w, lambda x: x IN ({_SLANG}))))
  FROM (SELECT id AS message_id, list_transform(regexp_split_to_array(lower(text), '{WHITE_CLASS}'), lambda x: trim(x, '.,!?;:')) AS w FROM messages)),
inp AS (
  SELECT m.id, m.telegram_id, m.chat_id, m.sender_id AS author_id, m.sent_us, s.normalized_text, s.token_count, m.is_outgoing, m.media_kind
  FROM messages m JOIN semantic s ON s.message_id = m.id WHERE m.in_memory_window AND NOT m.is_deleted),
utt AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY started_us, first_message_id) - 1 AS position FROM (
    SELECT chat_id, arg_min(id, telegram_id) AS first_message_id, any_value(author_id) AS author_id, any_value(is_outgoing) AS is_outgoing, min(sent_us) AS started_us,
      max(sent_us) AS ended_us, count(*) AS message_count, string_agg(normalized_text, ' ' ORDER BY telegram_id) FILTER (WHERE token_count > 0) AS text,
      count(*) FILTER (WHERE media_kind = 'voice') AS voice_count
    FROM (SELECT *, sum(st) OVER (PARTITION BY chat_id ORDER BY telegram_id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN lag(author_id) OVER w = author_id AND sent_us - lag(sent_us) OVER w <= 120000000 THEN 0 ELSE 1 END AS st
      FROM inp WINDOW w AS (PARTITION BY chat_id ORDER BY telegram_id)))
    GROUP BY chat_id, g HAVING count(*) FILTER (WHERE token_count > 0) > 0))"""

#: Starts every SQL twin: the view's tables as common table expressions.
BASE = f"WITH {_PARTS.strip().replace('NUMBERED', _NUMBERED)},{_DUCK} "


#: Tables of a session that are already written: (session, folder, name) -> DataFrame.
_written: dict[tuple[str, str, str], DataFrame] = {}
#: Posting indexes of a session: (session, folder) -> index.
_indexed: dict[tuple[str, str], postings.PostingIndex] = {}


class ChatView:
    """The view's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table make() gives, written at its first use in the session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            _written[key] = stored(make(), f"view-{name}")
        return _written[key]

    def _sql(self, last: str) -> DataFrame:
        for name in ("events", "documents"):
            self.table(name).createOrReplaceTempView(name)
        text = _PARTS.replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace("AS VARCHAR", "AS STRING")
        if last == "messages":  # numbers within a chat without a window over the chat
            m = self.spark.sql(f"WITH {text[: text.index(',\nNUMBERED')]} SELECT *, timestamp_micros(sent_us) AS sent_at FROM m")
            with_row_number(m, "telegram_id", order=("sent_at", "event_id")).drop("sent_at").createOrReplaceTempView("numbered_messages")
        return self.spark.sql(f"WITH {text.replace('NUMBERED', 'n AS (SELECT * FROM numbered_messages)') if last == 'messages' else text.replace('NUMBERED', _NUMBERED)} SELECT * FROM {last}")

    @cached_property
    def messages(self) -> DataFrame:
        return self.once("messages", lambda: self._sql("messages").withColumn("sent_at", F.timestamp_micros("sent_us")))

    @cached_property
    def dialogs(self) -> DataFrame:
        return self._sql("dialogs")

    @cached_property
    def chats(self) -> DataFrame:
        return chats.score_chats(self.dialogs)

    @cached_property
    def semantic(self) -> DataFrame:
        return self.once("semantic", lambda: layers.build_semantic(self.messages))

    @cached_property
    def signals(self) -> DataFrame:
        return self.once("signals", lambda: layers.extract_signals(self.messages))

    @cached_property
    def own_items(self) -> DataFrame:
        """The emoji and slang signals of own live messages in the window, which the reports on style read; other kinds are not made."""
        own = self.messages.where(F.col("is_outgoing") & F.col("in_memory_window") & ~F.col("is_deleted"))
        return self.once("own-items", lambda: layers.extract_signals(own, ("emoji_usage", "slang_markers")))

    @cached_property
    def links(self) -> DataFrame:
        live = self.messages.where(F.col("in_memory_window") & ~F.col("is_deleted"))
        return live.select(F.col("id").alias("message_id"), F.expr("chat_id * 1000000 + telegram_id div 25").alias("episode_id"), "chat_id", "telegram_id", "sent_at")

    @cached_property
    def episodes(self) -> DataFrame:
        return self.links.groupBy("episode_id", "chat_id").agg(F.count("*").alias("message_count"), F.min("sent_at").alias("started_at"), F.max("sent_at").alias("ended_at"))

    @cached_property
    def segmented(self) -> DataFrame:
        """The segmenter's own episodes of all messages, unlike those of links."""
        return episodes.segment_episodes(episodes.unepisoded_messages(self.messages, self.links.where("episode_id < 0")))

    @cached_property
    def utterance_input(self) -> DataFrame:
        return sessions.utterance_input(self.messages, self.semantic, self.chats)

    @cached_property
    def utterances(self) -> DataFrame:
        return sessions.build_utterances(self.utterance_input)

    @cached_property
    def turns(self) -> DataFrame:
        """utterances without their positions."""
        return sessions.build_utterances(self.utterance_input, positions=False)

    @cached_property
    def doc_utterances(self) -> DataFrame:
        """documents as turns, for retrieval."""
        return self.table("documents").select(F.col("doc_id").alias("first_message_id"), "text", F.lit(1).alias("message_count"), F.lit(True).alias("is_outgoing"), F.lit(1).alias("chat_id"), F.col("doc_id").alias("position"))

    @property
    def posting_index(self) -> postings.PostingIndex:
        """The index of doc_utterances, made at its first use in the session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _indexed:
            _indexed[key] = postings.build_index(self.doc_utterances)
        return _indexed[key]
