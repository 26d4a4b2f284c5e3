"""Every registered query of the chat operators with its SQL twin (None where SQL has none).

Outputs hold no timestamps (microseconds instead), doubles rounded to six places and integers
as longs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import chats, episodes, layers, postings, prompts, ranking, reports, search, sessions, upsert, vectors, windows
from ..plans import workloads
from ..sources import records, scratch, store
from ..streaming import ingest
from .view import BASE, EMOJI_CLASS, WHITE_CLASS, ChatView

Build = Callable[[ChatView], DataFrame]
_FOUND: dict[str, tuple[Build, str | None]] = {}


def _plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, view: bool = True) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        _FOUND[f.__name__] = (f, BASE + sql if sql and view else sql)
        return f

    return add


# functions over documents and messages

_DOC_WORDS = f"list_filter(regexp_split_to_array(text, '{WHITE_CLASS}'), lambda x: x <> '')"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"


@query(
    rf"""SELECT id, regexp_extract_all(text, '{EMOJI_CLASS}') AS emoji, text <> '' AND regexp_full_match(text, '({EMOJI_CLASS}| )+') AS emoji_only,
  CASE WHEN length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) < 5 THEN 'very_short' WHEN length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) <= 30 THEN 'short'
    WHEN length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) <= 150 THEN 'medium' ELSE 'long' END AS length_class,
  CASE WHEN length(text) <= 10 THEN 'tiny' WHEN length(text) <= 50 THEN 'short' WHEN length(text) <= 200 THEN 'medium' WHEN length(text) <= 500 THEN 'long' ELSE 'very_long' END AS length_bucket,
  CASE WHEN l = 0 THEN NULL WHEN u = l THEN 'all_caps' WHEN u = 0 THEN 'lower' WHEN regexp_matches(regexp_extract(text, '\p{{L}}'), '\p{{Lu}}') AND s > u THEN 'sentence' ELSE 'mixed' END AS capitalization,
  length(text) // 4 AS approx_tokens, {_TOKENS} AS tokens,
  CASE WHEN length(text) > 12 THEN concat(substr(text, 1, 12), '…') ELSE text END AS preview, length(regexp_replace(text, '[ \n\t]', '', 'g')) < 5 AS is_very_short,
  (length(text) - length(replace(text, '!!!', ''))) // 3 AS triple, (length(text) - length(replace(text, '..', ''))) // 2 AS dots,
  trim(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'), ' ') AS repeat_form
FROM (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u, length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS s FROM messages)"""
)
def text_functions(v: ChatView) -> DataFrame:
    t = F.col("text")
    marks = X.punctuation_counts(t)
    return v.messages.select(
        "id", X.collect_emoji(t).alias("emoji"), X.is_emoji_only(t).alias("emoji_only"), X.length_class(t).alias("length_class"), X.length_bucket(t).alias("length_bucket"),
        X.capitalization(t).alias("capitalization"), X.approx_tokens(t).alias("approx_tokens"), X.tokenize(t).alias("tokens"), X.preview(t, 12).alias("preview"), X.is_very_short(t).alias("is_very_short"),
        F.coalesce(marks["!!!"], F.lit(0)).alias("triple"), F.coalesce(marks[".."], F.lit(0)).alias("dots"), X.normalize_for_repeat(t).alias("repeat_form"),
    )


# maximal runs of one letter, three or longer; a message's last run of a letter counts
_RUNS = r"""runs AS (
  SELECT id, letter, arg_max(run, start) AS run, max(start) AS start FROM (
    SELECT id, c AS letter, count(*) AS run, min(i) AS start FROM (
      SELECT id, c, i, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM (
        SELECT id, unnest(chars) AS c, unnest(range(1, len(chars) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '(?s).') AS chars FROM messages))
      WHERE regexp_matches(c, '\p{L}'))
    GROUP BY id, c, g HAVING count(*) >= 3) GROUP BY id, letter)"""


@query(f", {_RUNS} SELECT letter, run, count(*) AS n FROM runs GROUP BY 1, 2")
def repeated_letters(v: ChatView) -> DataFrame:
    runs = v.messages.select("id", F.explode(X.repeated_chars(F.col("text"))).alias("letter", "run"))
    return runs.groupBy("letter", "run").agg(F.count("*").alias("n"))


@query(
    rf"""SELECT doc_id, CASE WHEN length(union_) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(union_), 6) END AS similarity
FROM (SELECT doc_id, a, b, list_distinct(list_concat(a, b)) AS union_ FROM (
  SELECT doc_id, list_distinct(flatten(list_transform({_TOKENS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS a,
    ['  t', ' th', 'the', 'he ', '  o', ' on', 'on '] AS b FROM documents))""".replace("length(union_)", "len(union_)"),
    view=False,
)
def trigram_similarity(v: ChatView) -> DataFrame:
    return v.table("documents").select("doc_id", X.trigram_similarity(F.col("text"), F.lit("the on")).alias("similarity"))


@query(
    r"""SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS distance
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""",
    view=False,
)
def cosine_distance(v: ChatView) -> DataFrame:
    e = v.table("embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", X.cosine_distance(F.col("x"), F.col("y")).alias("distance"))


@query(
    rf"""SELECT id, regexp_full_match(CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(chr(8205), chr(65039)) WHEN 2 THEN chr(127995) ELSE text END, '[{X.JOINERS}\x{{1F3FB}}-\x{{1F3FF}}]*') AS noise,
  sent_us // 86400000000 = (sent_us + id % 30 * 3600000000) // 86400000000 AS same_day, sticker_emoticon AS emoticon FROM messages"""
)
def small_functions(v: ChatView) -> DataFrame:
    """Noise emoji, days of pairs of times up to 29 hours apart, emoticons of sticker data."""
    piece = F.expr("id % 4")
    text = F.when(piece == 0, "").when(piece == 1, "\u200d\ufe0f").when(piece == 2, "\U0001f3fb").otherwise(F.col("text"))
    later = F.timestamp_micros(F.expr("sent_us + id % 30 * 3600000000"))
    meta = F.when(F.col("sticker_emoticon").isNotNull(), F.to_json(F.struct(F.col("sticker_emoticon").alias("Emoticon"))))
    return v.messages.select("id", X.is_emoji_noise(text).alias("noise"), X.same_utc_day(F.col("sent_at"), later).alias("same_day"), X.sticker_emoticon(meta).alias("emoticon"))


# chats, filters, layers


_REASONS = "CASE " + " ".join(f"WHEN type = '{kind}'{f' AND {flag}' if flag else ''} THEN '{why}'" for kind, flag, _, _, why in ((k, f, p, w, y.replace("'", "''")) for k, f, p, w, y in chats.SCORES)) + " END"


@query(f"SELECT id, title, type, {_REASONS} AS relevance_reason, round(relevance_score, 6) AS relevance_score, personality_surface, relevance_score >= 0.35 AS to_sync, personality_surface IN ('social', 'passive_consumption') AS windowed FROM chats")
def score_chats(v: ChatView) -> DataFrame:
    s = v.chats
    ok = chats.chats_to_sync(s).select("id", F.lit(True).alias("ok"))
    return s.join(ok, "id", "left").select("id", "title", "type", "relevance_reason", "relevance_score", "personality_surface", F.coalesce("ok", F.lit(False)).alias("to_sync"), chats.needs_windowing(F.col("personality_surface")).alias("windowed"))


@query("SELECT personality_surface, count(*) AS chats, count(*) FILTER (WHERE relevance_score >= 0.35) AS to_sync, count(*) FILTER (WHERE relevance_score < 0.35) AS excluded FROM chats GROUP BY 1")
def surface_summary(v: ChatView) -> DataFrame:
    return chats.surface_summary(v.chats)


@query(
    """SELECT m.id, m.chat_id, c.title AS chat_title, m.is_outgoing, m.sent_us AS sent_at, coalesce(l.episode_id, 0) AS episode_id, CAST(0 AS DOUBLE) AS rank, 'filter' AS match_type
FROM messages m JOIN chats c ON c.id = m.chat_id LEFT JOIN links l ON l.message_id = m.id
WHERE NOT m.is_deleted AND m.in_memory_window AND m.media_kind = 'photo' AND m.is_outgoing AND c.personality_surface = 'social' ORDER BY m.sent_us DESC, m.id DESC LIMIT 20"""
)
def filter_messages(v: ChatView) -> DataFrame:
    out = chats.filter_messages(v.messages, v.chats, v.links.select("message_id", "episode_id"), media_kind="photo", outgoing=True, surface="social")
    return out.drop("personality_surface", "text")


@query("SELECT id, chat_id, sender_id, sent_us FROM messages WHERE NOT is_deleted AND NOT is_outgoing ORDER BY sent_us DESC, id DESC LIMIT 100 OFFSET 50")
def list_messages(v: ChatView) -> DataFrame:
    return chats.list_messages(v.messages, outgoing=False, limit=5000, offset=50).select("id", "chat_id", "sender_id", "sent_us")


@query("SELECT id, type FROM chats")
def list_chats(v: ChatView) -> DataFrame:
    return chats.list_chats(v.chats.withColumn("updated_at", F.timestamp_seconds("id"))).select("id", "type")


@query("SELECT message_id, normalized_text, language, token_count, media_kind IN ('sticker', 'voice', 'round') OR token_count < 3 AS skip_embedding FROM semantic")
def build_semantic(v: ChatView) -> DataFrame:
    return layers.build_semantic(v.messages)


@query("SELECT signal_type, item, count(*) AS n FROM items GROUP BY 1, 2")
def signal_items(v: ChatView) -> DataFrame:
    rows = v.signals.where(F.col("signal_type").isin("emoji_usage", "slang_markers"))
    return rows.select("signal_type", F.explode(F.from_json("value_json", "array<string>")).alias("item")).groupBy("signal_type", "item").agg(F.count("*").alias("n"))


_COUNTED = ", ".join(f"(length(text) - length(replace(text, '{p}', ''))) // {len(p)}" for p in X.EMPHASIS)
_SLANG_LIST = ", ".join(f"'{w}'" for w in X.SLANG)
_KINDS = rf"""{_RUNS},
emo AS (SELECT id, regexp_extract_all(text, '{EMOJI_CLASS}') AS found FROM messages),
sl AS (SELECT id, list_filter(list_transform(regexp_split_to_array(lower(text), '{WHITE_CLASS}'), lambda x: trim(x, '.,!?;:')), lambda x: x IN ({_SLANG_LIST})) AS found FROM messages),
cased AS (SELECT id, text, media_kind, sticker_emoticon, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u,
  length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS s, length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) AS dense FROM messages),
kinds AS (
  SELECT 'emoji_usage' AS signal_type, CAST(found AS VARCHAR) AS v FROM emo WHERE len(found) > 0
  UNION ALL SELECT 'emoji_only', 'true' FROM messages WHERE regexp_full_match(text, '({EMOJI_CLASS}| )+') OR (text = '' AND media_kind = 'sticker')
  UNION ALL SELECT 'punctuation_style', CAST(m AS VARCHAR) FROM (SELECT [{_COUNTED}] AS m FROM messages) WHERE list_sum(m) > 0
  UNION ALL SELECT 'capitalization', CASE WHEN u = l THEN 'all_caps' WHEN u = 0 THEN 'lower' WHEN regexp_matches(regexp_extract(text, '\p{{L}}'), '\p{{Lu}}') AND s > u THEN 'sentence' ELSE 'mixed' END FROM cased WHERE l > 0
  UNION ALL SELECT 'length_class', CASE WHEN dense < 5 THEN 'very_short' WHEN dense <= 30 THEN 'short' WHEN dense <= 150 THEN 'medium' ELSE 'long' END FROM cased
  UNION ALL SELECT 'media_kind', media_kind FROM messages WHERE media_kind <> ''
  UNION ALL SELECT 'sticker_usage', sticker_emoticon FROM messages WHERE sticker_emoticon IS NOT NULL
  UNION ALL SELECT 'repeated_chars', string_agg(concat(letter, CAST(run AS VARCHAR)), ' ' ORDER BY start) FROM runs GROUP BY id
  UNION ALL SELECT 'slang_markers', CAST(list_filter(found, lambda x, i: list_position(found, x) = i) AS VARCHAR) FROM sl WHERE len(found) > 0
  UNION ALL SELECT 'has_media', 'true' FROM messages WHERE media_kind <> '')"""


@query(f", {_KINDS} SELECT signal_type, count(*) AS n, count(DISTINCT v) AS values FROM kinds GROUP BY 1")
def signals_by_kind(v: ChatView) -> DataFrame:
    return v.signals.groupBy("signal_type").agg(F.count("*").alias("n"), F.count_distinct("value_json").alias("values"))


@query(
    """SELECT id, telegram_id, chat_id, CASE chat_id % 5 WHEN 0 THEN 'saved_messages' WHEN 1 THEN 'private' WHEN 2 THEN 'group' WHEN 3 THEN 'supergroup' ELSE 'channel' END AS chat_type, sent_us AS sent_at
FROM messages WHERE media_kind = 'voice' AND in_memory_window AND NOT is_deleted AND id % 2 = 0"""
)
def pending_transcription(v: ChatView) -> DataFrame:
    done = F.when(F.col("message_id") % 2 == 1, F.timestamp_seconds(F.lit(0)))
    return layers.pending_transcription(v.messages, v.semantic.withColumn("transcribed_at", done), v.chats)


@query(
    """SELECT s.message_id, CASE WHEN s.message_id % 4 = 0 THEN concat('voice ', CAST(s.message_id AS VARCHAR)) ELSE s.normalized_text END AS normalized_text,
  CASE WHEN s.message_id % 4 = 0 THEN 2 ELSE s.token_count END AS token_count, s.message_id % 4 = 0 OR s.message_id % 4 = 1 AS done FROM semantic s WHERE s.media_kind = 'voice'"""
)
def apply_transcripts(v: ChatView) -> DataFrame:
    voice = v.messages.where("media_kind = 'voice'").select(F.col("id").alias("message_id"))
    base = v.semantic.join(voice, "message_id").withColumn("transcribed_at", F.when(F.col("message_id") % 4 == 1, F.timestamp_seconds(F.lit(1))))
    t = voice.where("message_id % 4 < 2").select("message_id", F.concat(F.lit("voice "), F.col("message_id").cast("string")).alias("transcript"), F.timestamp_seconds(F.lit(2)).alias("done_at"))
    return layers.apply_transcripts(base, t).select("message_id", "normalized_text", "token_count", F.col("transcribed_at").isNotNull().alias("done"))


@query("SELECT id FROM messages WHERE in_memory_window AND NOT is_deleted AND id % 3 = 0")
def pending_rebuild(v: ChatView) -> DataFrame:
    return layers.pending_rebuild(v.messages, v.semantic.where("message_id % 3 <> 0")).select("id")


# merging


@query(
    """SELECT id, chat_id, telegram_id, CASE WHEN id % 2 = 0 THEN concat('new ', text) ELSE text END AS text, CASE WHEN id % 5 = 0 THEN -1 ELSE sender_id END AS sender_id FROM messages"""
)
def upsert_messages(v: ChatView) -> DataFrame:
    cols = ["id", "chat_id", "telegram_id", "text", "sender_id"]
    m = v.messages.select(*cols)
    base = m.where("id % 3 <> 0 or id % 2 = 1").withColumn("sender_id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("sender_id")))
    new = m.where("id % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    fresh = new.where("id % 3 = 0").withColumn("sender_id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("sender_id")))
    return upsert.upsert(base, new.where("id % 3 <> 0").unionByName(fresh), ["chat_id", "telegram_id"], ["text"])


@query("SELECT message_id, CASE WHEN message_id % 6 = 0 THEN 'transcript' ELSE normalized_text END AS normalized_text, CASE WHEN message_id % 6 = 0 THEN 'none' ELSE language END AS language, message_id % 6 = 0 AS transcribed FROM semantic WHERE message_id % 3 = 0 OR message_id % 2 = 1")
def upsert_semantic(v: ChatView) -> DataFrame:
    """A third of the rows is stored, half of these with a transcript, which stays; the odd rows and the stored ones come again."""
    new = v.semantic.withColumn("transcribed_at", F.lit(None).cast("timestamp"))
    heard = F.col("message_id") % 2 == 0
    stale = {"normalized_text": F.when(heard, "transcript").otherwise("old"), "language": F.lit("none"), "transcribed_at": F.when(heard, F.timestamp_seconds(F.lit(1)))}
    out = upsert.upsert_semantic(new.where("message_id % 3 = 0").withColumns(stale), new.where("message_id % 3 = 0 or message_id % 2 = 1"))
    return out.select("message_id", "normalized_text", "language", F.col("transcribed_at").isNotNull().alias("transcribed"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM messages")
def insert_if_absent(v: ChatView) -> DataFrame:
    ids = v.messages.select("id")
    return upsert.insert_if_absent(ids.where("id % 2 = 0").withColumn("state", F.lit("old")), ids.withColumn("state", F.lit("new")), ["id"])


@query("SELECT DISTINCT sender_id AS id, CASE WHEN sender_id = 1000000 THEN 'self' END AS username FROM messages")
def ensure_users(v: ChatView) -> DataFrame:
    users = v.spark.createDataFrame([(1_000_000, "old")], "id long, username string")
    return upsert.ensure_users(users, v.spark.createDataFrame([(1_000_000, "self")], "id long, username string"), v.messages)


@query("SELECT chat_id, count(*) AS new, max(telegram_id) AS last_message_id FROM messages WHERE chat_id % 2 = 1 OR telegram_id > 100 GROUP BY chat_id")
def new_since_cursor(v: ChatView) -> DataFrame:
    cursors = v.dialogs.where("id % 2 = 0").select(F.col("id").alias("chat_id"), F.lit(100).cast("long").alias("last_message_id"))
    new, marks = upsert.new_since_cursor(v.messages, cursors)
    return new.groupBy("chat_id").agg(F.count("*").alias("new")).join(marks, "chat_id")


@query("SELECT chat_id, count(*) FILTER (WHERE is_deleted OR telegram_id % 10 = 0) AS gone FROM messages GROUP BY chat_id")
def mark_deleted(v: ChatView) -> DataFrame:
    marked = upsert.mark_deleted(v.messages, v.messages.where("telegram_id % 10 = 0").select("telegram_id", "chat_id"))
    return marked.groupBy("chat_id").agg(F.count_if("is_deleted").alias("gone"))


# windows

_LIVE = "live AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY telegram_id) AS rn FROM messages WHERE NOT is_deleted)"


@query(
    f"""SELECT m.id, CASE WHEN c.personality_surface NOT IN ('social', 'passive_consumption') OR m.is_deleted THEN m.in_memory_window ELSE w.near OR t.telegram_id IS NOT NULL END AS in_memory_window
FROM messages m JOIN chats c ON c.id = m.chat_id
LEFT JOIN (SELECT id, max(is_outgoing) OVER (PARTITION BY chat_id ORDER BY telegram_id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near FROM messages WHERE NOT is_deleted) w ON w.id = m.id
LEFT JOIN (SELECT DISTINCT chat_id, reply_to_id AS telegram_id FROM messages WHERE is_outgoing AND NOT is_deleted AND reply_to_id IS NOT NULL) t ON t.chat_id = m.chat_id AND t.telegram_id = m.telegram_id"""
)
def participation_windows(v: ChatView) -> DataFrame:
    return windows.participation_windows(v.messages, v.chats, before=3, after=2).select("id", "in_memory_window")


@query(
    """SELECT chat_id, count(*) FILTER (WHERE in_memory_window AND NOT is_outgoing AND NOT near) AS isolated
FROM (SELECT *, max(is_outgoing) OVER (PARTITION BY chat_id ORDER BY telegram_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM messages WHERE NOT is_deleted) GROUP BY chat_id"""
)
def isolated_in_window(v: ChatView) -> DataFrame:
    return windows.isolated_in_window(v.messages, 2)


def _anchor_sql(keep: str) -> str:
    return f""", {_LIVE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY rn) AS k, count(*) OVER (PARTITION BY chat_id) AS n FROM live WHERE is_outgoing)
SELECT a.chat_id, a.id AS anchor_id, r.rn - a.rn AS row_offset, r.id AS message_id, r.is_outgoing FROM ranked a JOIN live r ON r.chat_id = a.chat_id AND r.rn BETWEEN a.rn - 5 AND a.rn + 5 WHERE {keep}"""


@query(_anchor_sql("a.k <= 3"))
def window_anchors(v: ChatView) -> DataFrame:
    return windows.window_anchors(v.messages).drop("text")


@query(_anchor_sql("a.k IN (greatest(1, (a.n + 9) // 10), greatest(1, (a.n + 1) // 2), a.n)"))
def window_anchors_distributed(v: ChatView) -> DataFrame:
    return windows.window_anchors_distributed(v.messages).drop("text")


@query(
    """SELECT m.chat_id, count(*) AS total, count(*) FILTER (WHERE in_memory_window) AS in_window, count(*) FILTER (WHERE is_outgoing) AS anchors,
  count(*) FILTER (WHERE in_memory_window AND m.id % 4 = 0) AS pending, round(100.0 * count(*) FILTER (WHERE in_memory_window) / count(*), 6) AS kept_pct
FROM messages m JOIN chats c ON c.id = m.chat_id WHERE NOT is_deleted GROUP BY ROLLUP (m.chat_id)"""
)
def window_stats(v: ChatView) -> DataFrame:
    return windows.window_stats(v.messages, v.semantic.where("message_id % 4 <> 0"), v.chats)


# turns


@query("SELECT chat_id, first_message_id, position, author_id, is_outgoing, started_us AS started_at, ended_us AS ended_at, message_count, text, voice_count, voice_count > 0 AS has_voice FROM utt")
def build_utterances(v: ChatView) -> DataFrame:
    return v.utterances.drop("chat_title")


_BURSTS = """seq AS (SELECT chat_id, telegram_id, is_outgoing, lag(is_outgoing) OVER w AS p, (sent_us - lag(sent_us) OVER w) / 1000000.0 AS gap FROM messages WHERE NOT is_deleted AND in_memory_window
  WINDOW w AS (PARTITION BY chat_id ORDER BY telegram_id)),
b AS (SELECT *, sum(nb) OVER (PARTITION BY chat_id ORDER BY telegram_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
  SELECT *, CASE WHEN NOT coalesce(p, FALSE) OR gap > 120 THEN 1 ELSE 0 END AS nb FROM seq WHERE is_outgoing)),
bursts AS (SELECT round(avg_size, 6) AS avg_size, round(p90_size, 6) AS p90_size, round(p50_gap, 6) AS p50_gap, round(p90_gap, 6) AS p90_gap
  FROM (SELECT avg(n) AS avg_size, quantile_cont(n, 0.9) AS p90_size FROM (SELECT count(*) AS n FROM b GROUP BY chat_id, burst)),
       (SELECT coalesce(quantile_cont(gap, 0.5), 0) AS p50_gap, coalesce(quantile_cont(gap, 0.9), 0) AS p90_gap FROM b WHERE nb = 0 AND gap >= 0))"""


@query(f", {_BURSTS} SELECT * FROM bursts")
def burst_stats(v: ChatView) -> DataFrame:
    return sessions.burst_stats(v.messages)


@query(
    """, gaps AS (SELECT unnest([30, 60, 120, 300]) AS gap_seconds),
f AS (SELECT g.gap_seconds, i.*, CASE WHEN lag(author_id) OVER w = author_id AND sent_us - lag(sent_us) OVER w <= g.gap_seconds * 1000000 THEN 0 ELSE 1 END AS st
  FROM inp i, gaps g WINDOW w AS (PARTITION BY g.gap_seconds, chat_id ORDER BY telegram_id)),
t AS (SELECT gap_seconds, count(*) AS n FROM (SELECT *, sum(st) OVER (PARTITION BY gap_seconds, chat_id ORDER BY telegram_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
  GROUP BY gap_seconds, chat_id, g HAVING count(*) FILTER (WHERE token_count > 0) > 0)
SELECT CAST(gap_seconds AS BIGINT) AS gap_seconds, count(*) AS utterances, round(avg(n), 6) AS mean_messages, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 6) AS multi_pct FROM t GROUP BY 1"""
)
def compare_gaps(v: ChatView) -> DataFrame:
    return sessions.compare_gaps(v.utterance_input)


@query("SELECT first_message_id, chat_id, message_count, round((ended_us - started_us) / 1000000.0, 6) AS duration_secs, text FROM utt WHERE message_count > 1 ORDER BY message_count DESC, first_message_id LIMIT 50")
def top_bursts(v: ChatView) -> DataFrame:
    return sessions.top_bursts(v.turns)


def _pick(value: str, source: str, p: int, name: str) -> str:
    return f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r, count(*) OVER () AS n FROM {source}) WHERE r = n * {p} // 100) AS {name}"


@query(
    f"""SELECT count(*) AS utterances, round(avg(message_count), 6) AS mean, max(message_count) AS max, {_pick('message_count', 'utt', 50, 'median')}, {_pick('message_count', 'utt', 90, 'p90')},
  count(*) FILTER (WHERE message_count = 1) AS n_1, count(*) FILTER (WHERE message_count = 2) AS n_2, count(*) FILTER (WHERE message_count BETWEEN 3 AND 5) AS n_3_5,
  count(*) FILTER (WHERE message_count BETWEEN 6 AND 10) AS n_6_10, count(*) FILTER (WHERE message_count > 10) AS n_over_10, count(*) FILTER (WHERE voice_count > 0) AS has_voice,
  count(*) FILTER (WHERE voice_count > 0 AND voice_count = message_count) AS voice_only, count(*) FILTER (WHERE voice_count > 0 AND voice_count < message_count) AS voice_mixed,
  count(*) FILTER (WHERE voice_count > 0 AND message_count > 1) AS voice_in_burst FROM utt"""
)
def utterance_stats(v: ChatView) -> DataFrame:
    return sessions.utterance_stats(v.turns)


@query(
    f""", tok AS (SELECT greatest(length(text) // 4, 1) AS t FROM utt)
SELECT {', '.join(_pick('t', 'tok', p, f'p{p}') for p in (50, 75, 90, 95, 99))}, max(t) AS max, count(*) FILTER (WHERE t < 64) AS under_64, count(*) FILTER (WHERE t >= 64 AND t < 128) AS under_128,
  count(*) FILTER (WHERE t >= 128 AND t < 256) AS under_256, count(*) FILTER (WHERE t >= 256 AND t < 512) AS under_512, count(*) FILTER (WHERE t >= 512 AND t < 1024) AS under_1024,
  count(*) FILTER (WHERE t >= 1024) AS from_1024, round(100.0 * count(*) FILTER (WHERE t >= 256) / count(*), 6) AS from_256_pct,
  round(100.0 * count(*) FILTER (WHERE t >= 512) / count(*), 6) AS from_512_pct, round(100.0 * count(*) FILTER (WHERE t >= 1024) / count(*), 6) AS from_1024_pct FROM tok"""
)
def token_length_audit(v: ChatView) -> DataFrame:
    return sessions.token_length_audit(v.turns)


@query(
    """SELECT first_message_id, greatest(length(text) // 4, 1) AS tokens, message_count, is_outgoing, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 60), '…') ELSE text END AS preview
FROM utt ORDER BY tokens DESC, first_message_id LIMIT 10"""
)
def longest_utterances(v: ChatView) -> DataFrame:
    return sessions.longest_utterances(v.turns)


@query(
    """SELECT count(*) FILTER (WHERE is_outgoing) AS outgoing, count(*) FILTER (WHERE NOT is_outgoing) AS incoming, count(*) FILTER (WHERE message_count > 1) AS multi,
  round(100.0 * count(*) FILTER (WHERE message_count > 1) / count(*), 6) AS multi_pct, round(avg(message_count), 6) AS mean_messages FROM utt"""
)
def utterance_summary(v: ChatView) -> DataFrame:
    return sessions.utterance_summary(v.turns)


# episodes


# one step a message: what is open before it (its first row and size), and whether the message begins anew
_SEGMENTS = f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)},
live AS (SELECT id, telegram_id, chat_id, sender_id, reply_to_id, sent_us, row_number() OVER (PARTITION BY chat_id ORDER BY sent_us, telegram_id, id) AS n FROM messages WHERE in_memory_window AND NOT is_deleted),
target AS (SELECT chat_id, telegram_id, max(n) AS reply_n FROM live WHERE telegram_id <> 0 GROUP BY ALL),
gaps AS (SELECT l.chat_id, l.n, coalesce(t.reply_n, -1) AS reply_n, l.sent_us - lag(l.sent_us) OVER w AS gap, l.sent_us // 86400000000 <> lag(l.sent_us) OVER w // 86400000000 AS midnight
  FROM live l LEFT JOIN target t ON t.chat_id = l.chat_id AND t.telegram_id = l.reply_to_id WINDOW w AS (PARTITION BY l.chat_id ORDER BY l.n)),
tiers AS (SELECT *, CASE WHEN gap >= 14400000000 THEN 'time_gap_hard' WHEN gap >= 3600000000 THEN 'time_gap_medium' WHEN gap >= 1200000000 THEN 'time_gap_soft' ELSE '' END AS tier FROM gaps),
based AS (SELECT *, CAST(CASE tier WHEN 'time_gap_hard' THEN 0.90 WHEN 'time_gap_medium' THEN 0.48 WHEN 'time_gap_soft' THEN 0.18 ELSE 0 END AS FLOAT) AS base FROM tiers),
lowered AS (SELECT *, greatest(base - CAST(0.38 AS FLOAT), CAST(0 AS FLOAT)) AS low FROM based),
rule AS (SELECT chat_id, n, reply_n, tier,
  CASE WHEN midnight THEN CAST(least(CAST(base AS DOUBLE) * CAST(CAST(1.40 AS FLOAT) AS DOUBLE), 1.0) AS FLOAT) ELSE base END AS outside,
  CASE WHEN midnight THEN CAST(least(CAST(low AS DOUBLE) * CAST(CAST(1.40 AS FLOAT) AS DOUBLE), 1.0) AS FLOAT) ELSE low END AS inside FROM lowered),
walk AS (
  SELECT chat_id, n, n AS begin_, CAST(1 AS BIGINT) AS size, 'initial' AS method, CAST(1 AS FLOAT) AS score FROM rule WHERE n = 1
  UNION ALL
  SELECT chat_id, n, CASE WHEN full_ OR s >= CAST(0.50 AS FLOAT) THEN n ELSE begin_ END, CASE WHEN full_ OR s >= CAST(0.50 AS FLOAT) THEN 1 ELSE size + 1 END,
    CASE WHEN full_ THEN 'size_limit' WHEN s >= CAST(0.50 AS FLOAT) THEN tier ELSE method END, CASE WHEN full_ THEN CAST(1 AS FLOAT) WHEN s >= CAST(0.50 AS FLOAT) THEN s ELSE score END
  FROM (SELECT r.chat_id, r.n, r.tier, w.begin_, w.size, w.method, w.score, w.size >= 60 AS full_, CASE WHEN r.reply_n >= w.begin_ AND r.reply_n < r.n THEN r.inside ELSE r.outside END AS s
    FROM walk w JOIN rule r ON r.chat_id = w.chat_id AND r.n = w.n + 1)),
segs AS (SELECT chat_id, begin_, count(*) AS size, any_value(method) AS method, any_value(score) AS score FROM walk GROUP BY ALL),
into_ AS (SELECT *, last_value(CASE WHEN size >= 2 OR begin_ = 1 THEN begin_ END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY begin_ ROWS UNBOUNDED PRECEDING) AS segment FROM segs),
heads AS (SELECT i.chat_id, i.begin_, i.segment, h.method, h.score FROM into_ i JOIN segs h ON h.chat_id = i.chat_id AND h.begin_ = i.segment),
member AS (SELECT l.*, h.segment, h.method, h.score FROM live l JOIN walk w ON w.chat_id = l.chat_id AND w.n = l.n JOIN heads h ON h.chat_id = w.chat_id AND h.begin_ = w.begin_)"""


@query(
    _SEGMENTS
    + """ SELECT episode_id, chat_id, started_at, ended_at, CAST(round((ended_at - started_at) / 1e6) AS BIGINT) AS duration_secs,
  CASE WHEN message_count = 1 AND segmented_by = 'initial' THEN 'monologue' WHEN people >= 3 THEN 'group' WHEN people = 1 THEN 'monologue' WHEN ended_at - started_at > 86400000000 THEN 'async'
    WHEN replies THEN 'thread' WHEN ended_at - started_at < 300000000 AND message_count >= 4 THEN 'burst' ELSE 'dialogue' END AS episode_type,
  message_count, participant_ids, segmented_by, round(CAST(score AS DOUBLE), 6) AS confidence
FROM (SELECT arg_min(id, n) AS episode_id, chat_id, min(sent_us) AS started_at, max(sent_us) AS ended_at, count(*) AS message_count, count(DISTINCT sender_id) FILTER (WHERE sender_id <> 0) AS people,
    coalesce(array_to_string(list_sort(list(DISTINCT sender_id) FILTER (WHERE sender_id <> 0)), ','), '') AS participant_ids, bool_or(coalesce(reply_to_id, 0) <> 0) AS replies, any_value(method) AS segmented_by, any_value(score) AS score
  FROM member GROUP BY chat_id, segment)""",
    view=False,
)
def segment_episodes(v: ChatView) -> DataFrame:
    return episodes.build_episodes(v.segmented).withColumn("participant_ids", F.array_join(F.transform("participant_ids", lambda x: x.cast("string")), ","))


@query(_SEGMENTS + " SELECT m.id AS message_id, f.id AS episode_id, m.n - m.segment AS position FROM member m JOIN live f ON f.chat_id = m.chat_id AND f.n = m.segment", view=False)
def episode_links(v: ChatView) -> DataFrame:
    return episodes.episode_links(v.segmented)


@query("SELECT m.id FROM messages m LEFT JOIN links l ON l.message_id = m.id WHERE m.in_memory_window AND NOT m.is_deleted AND l.episode_id % 2 = 1")
def unepisoded_messages(v: ChatView) -> DataFrame:
    return episodes.unepisoded_messages(v.messages, v.links.where("episode_id % 2 = 0")).select("id")


_EPISODE_DOCS = """SELECT episode_id, string_agg(line, chr(10) ORDER BY telegram_id) AS semantic_text FROM (
  SELECT l.episode_id, l.telegram_id, concat(CASE WHEN m.is_outgoing THEN '→ ' ELSE '← ' END, body) AS line FROM (
    SELECT m.id, m.is_outgoing, CASE WHEN m.media_kind = 'sticker' THEN CASE WHEN m.sticker_emoticon <> '' THEN concat('[', m.sticker_emoticon, ']') ELSE '[sticker]' END
      WHEN m.media_kind IN ('voice', 'round') THEN '[voice]' ELSE s.normalized_text END AS body FROM messages m JOIN semantic s ON s.message_id = m.id) m
  JOIN links l ON l.message_id = m.id WHERE body <> '') GROUP BY episode_id"""


@query(_EPISODE_DOCS)
def episode_docs(v: ChatView) -> DataFrame:
    links = v.links.withColumnRenamed("telegram_id", "position")
    return episodes.episode_docs(links, v.messages, v.semantic).select("episode_id", "semantic_text")


@query("SELECT episode_id, chat_id, message_count FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY started_us DESC, episode_id) AS r FROM episodes) WHERE r > 1 AND r <= 6")
def list_episodes(v: ChatView) -> DataFrame:
    return episodes.list_episodes(v.episodes, limit=5, offset=1).select("episode_id", "chat_id", "message_count")


# retrieval

#: Eight words for each document whose id is divisible by 100: the longest of its whole text.
_Q_SQL = rf"""q(query_id, query) AS (SELECT doc_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct({_TOKENS}), lambda w: concat(lpad(CAST(100000 - length(w) AS VARCHAR), 6, '0'), w))), 1, 8), lambda x: substr(x, 7)), ' ')
  FROM documents WHERE doc_id % 100 = 0)"""
_BM25_SQL = rf"""{_Q_SQL}, d AS (SELECT doc_id AS id, {_TOKENS} AS tokens FROM documents), c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
qt AS (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM q),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), c GROUP BY 1, 2),
sz AS (SELECT doc_id AS id, least(len({_DOC_WORDS}), 100) AS n FROM documents),
rr AS (SELECT query_id, id, score * (n / (n + 10.0)) AS score FROM bm JOIN sz USING (id) WHERE n > 0)"""


def _queries(v: ChatView) -> DataFrame:
    keyed = F.transform(F.array_distinct(X.tokenize(F.col("text"))), lambda w: F.concat(F.lpad((100_000 - F.length(w)).cast("string"), 6, "0"), w))
    words = F.transform(F.slice(F.array_sort(keyed), 1, 8), lambda x: F.substring(x, 7, 1 << 20))
    return v.table("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def _retrieved(v: ChatView, docs: DataFrame) -> DataFrame:
    return ranking.retrieve(_queries(v), docs, lambda q, u: ranking.best_reranked(q, u, 10, 6))


@query(
    rf"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS tokens, least(len({_DOC_WORDS}), 100) AS n FROM documents), c AS (SELECT avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT id, term, dl, n, count(*) AS tf FROM (SELECT id, n, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY 1, 2, 3, 4)
SELECT term, count(*) AS df, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS best, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (n / (n + 10.0))), 6) AS best_scaled
FROM tf, c GROUP BY term""",
    view=False,
)
def posting_index(v: ChatView) -> DataFrame:
    """Each term of the posting table."""
    return v.posting_index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best"), F.max("best_scaled").alias("best_scaled"))


@query(f"WITH {_BM25_SQL} SELECT query_id, id AS first_message_id, round(score, 6) AS score FROM bm WHERE score > 0", view=False)
def bm25(v: ChatView) -> DataFrame:
    return ranking.bm25(_queries(v), v.doc_utterances)


@query(f"WITH {_BM25_SQL} SELECT query_id, id AS first_message_id, round(score, 6) AS score FROM rr", view=False)
def rerank_by_length(v: ChatView) -> DataFrame:
    return ranking.bm25_reranked(_queries(v), v.doc_utterances)


@query(
    f"""WITH {_BM25_SQL} SELECT query_id, first_message_id, rank, round(score, 6) AS score FROM (
  SELECT query_id, id AS first_message_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM rr) WHERE rank <= 10""",
    view=False,
)
def retrieve(v: ChatView) -> DataFrame:
    return _retrieved(v, v.doc_utterances).select("query_id", "first_message_id", "rank", "score")


@query(
    f"""WITH {_BM25_SQL} SELECT t.query_id, t.rank, t.id AS hit_id, d.doc_id - t.id AS turn_offset, d.doc_id AS first_message_id FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM rr) t JOIN documents d ON d.doc_id BETWEEN t.id - 2 AND t.id + 2 WHERE t.rank <= 10""",
    view=False,
)
def with_context(v: ChatView) -> DataFrame:
    docs = v.doc_utterances.withColumns({"author_id": F.lit(1), "started_at": F.timestamp_seconds(F.lit(0))})
    return ranking.with_context(_retrieved(v, docs), docs).select("query_id", "rank", "hit_id", "turn_offset", "first_message_id")


_NEAR_SQL = """c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v)), 6) AS distance
  FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)"""


def _vectors(v: ChatView) -> tuple[DataFrame, DataFrame]:
    e = v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e


@query(f"WITH {_NEAR_SQL} SELECT query_id, id, distance FROM vr WHERE rank <= 50", view=False)
def nearest_vectors(v: ChatView) -> DataFrame:
    q, corpus = _vectors(v)
    return vectors.nearest(q, corpus, 50)


@query(f"WITH {_NEAR_SQL} SELECT query_id, id AS first_message_id, round(1 - distance, 6) AS score FROM vr WHERE rank <= 50 AND id % 3 <> 0", view=False)
def vector_search(v: ChatView) -> DataFrame:
    q, corpus = _vectors(v)
    known = corpus.where("id % 3 <> 0").select(F.col("id").alias("first_message_id"))
    return vectors.vector_search(q, corpus.withColumnRenamed("id", "first_message_id"), known)


@query(
    """WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS message_id, round(1 - list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v)), 6) AS distance
  FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND c.vec_id % 2 = 0 AND c.vec_id % 7 <> 0)
SELECT query_id, message_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, message_id) AS r FROM d) WHERE r <= 10""",
    view=False,
)
def vector_search_messages(v: ChatView) -> DataFrame:
    q, corpus = _vectors(v)
    store = corpus.select(F.col("id").alias("message_id"), "vector", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("model"))
    return vectors.vector_search_messages(q, store, corpus.select("id", (F.col("id") % 7 == 0).alias("is_deleted")), "a")


_RRF_SQL = f"""WITH {_BM25_SQL}, {_NEAR_SQL.replace('c AS (', 'e AS (').replace('FROM c q JOIN c ON', 'FROM e q JOIN e c ON').replace('d AS (SELECT q', 'vd AS (SELECT q').replace('FROM d)', 'FROM vd)')},
lx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM rr),
vx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM vr WHERE rank <= 50 AND query_id IN (SELECT query_id FROM q) AND id IN (SELECT doc_id FROM documents)),
hy AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM lx UNION ALL SELECT * FROM vx) GROUP BY 1, 2)"""


def _near(v: ChatView) -> DataFrame:
    q, corpus = _vectors(v)
    q = q.join(_queries(v).select("query_id"), "query_id", "left_semi")
    near = vectors.vector_search(q, corpus.withColumnRenamed("id", "first_message_id"), v.doc_utterances)
    return near.withColumn("score", F.round("score", 6))


@query(f"{_RRF_SQL} SELECT query_id, id AS first_message_id, round(score, 6) AS score FROM hy", view=False)
def hybrid_rrf(v: ChatView) -> DataFrame:
    return ranking.hybrid_lists(_queries(v), v.doc_utterances, _near(v))


@query(
    f"""{_RRF_SQL}, hx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hy),
o AS (SELECT q.query_id, l.id AS l, x.id AS x, h.id AS h FROM q LEFT JOIN (
    SELECT query_id, id FROM lx WHERE rank <= 10 UNION SELECT query_id, id FROM vx WHERE rank <= 10 UNION SELECT query_id, id FROM hx WHERE rank <= 10) a USING (query_id)
  LEFT JOIN lx l ON l.query_id = a.query_id AND l.id = a.id AND l.rank <= 10 LEFT JOIN vx x ON x.query_id = a.query_id AND x.id = a.id AND x.rank <= 10 LEFT JOIN hx h ON h.query_id = a.query_id AND h.id = a.id AND h.rank <= 10)
SELECT query_id, count(l) AS lexical_n, count(x) AS vector_n, count(*) FILTER (WHERE l IS NOT NULL AND x IS NOT NULL) AS overlap, count(*) FILTER (WHERE l IS NULL AND x IS NOT NULL) AS vector_only,
  count(*) FILTER (WHERE h IS NOT NULL AND l IS NOT NULL AND x IS NOT NULL) AS hybrid_both, count(*) FILTER (WHERE h IS NOT NULL AND l IS NOT NULL AND x IS NULL) AS hybrid_lexical,
  count(*) FILTER (WHERE h IS NOT NULL AND l IS NULL AND x IS NOT NULL) AS hybrid_vector,
  CASE WHEN count(x) > 0 THEN round(100.0 * count(*) FILTER (WHERE l IS NULL AND x IS NOT NULL) / count(x), 6) ELSE 0.0 END AS vector_only_pct FROM o GROUP BY ROLLUP (query_id)""",
    view=False,
)
def overlap_audit(v: ChatView) -> DataFrame:
    return ranking.overlap_audit(_queries(v), *ranking.first_lists(_queries(v), v.doc_utterances, _near(v)))


def _audit(v: ChatView) -> DataFrame:
    q, docs = _queries(v), v.doc_utterances
    parts = [ranking.with_rank(ranking.best_reranked(q, docs, 10, 6, scaled), 10).withColumn("scorer", F.lit(s)) for s, scaled in (("bm25", False), ("rerank", True))]
    return ranking.retrieval_audit(q, parts[0].unionByName(parts[1]).join(docs, "first_message_id"))


@query(
    f"""WITH {_BM25_SQL}, h AS (SELECT 'bm25' AS scorer, * FROM bm UNION ALL SELECT 'rerank', * FROM rr),
t AS (SELECT h.*, row_number() OVER (PARTITION BY scorer, query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h)
SELECT scorer, query_id, count(*) AS results, round(100.0 * count(*) FILTER (WHERE len({_DOC_WORDS}) > 20) / count(*), 6) AS long_pct, CAST(0 AS DOUBLE) AS multi_pct,
  CASE WHEN count(*) >= 2 THEN round(arg_min(round(score, 6), rank) / arg_max(round(score, 6), rank), 6) ELSE 0.0 END AS score_gap FROM t JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY 1, 2""",
    view=False,
)
def retrieval_audit(v: ChatView) -> DataFrame:
    return _audit(v)


@query(
    f"""WITH {_BM25_SQL}, h AS (SELECT 'bm25' AS scorer, * FROM bm UNION ALL SELECT 'rerank', * FROM rr),
t AS (SELECT h.*, row_number() OVER (PARTITION BY scorer, query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h),
a AS (SELECT scorer, query_id, 100.0 * count(*) FILTER (WHERE len({_DOC_WORDS}) > 20) / count(*) AS long_pct,
  CASE WHEN count(*) >= 2 THEN arg_min(round(score, 6), rank) / arg_max(round(score, 6), rank) ELSE 0.0 END AS score_gap FROM t JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY 1, 2),
e AS (SELECT scorer, coalesce(long_pct, 0) AS long_pct, coalesce(score_gap, 0) AS score_gap FROM q CROSS JOIN (VALUES ('bm25'), ('rerank')) s(scorer) LEFT JOIN a USING (scorer, query_id)),
m AS (SELECT avg(long_pct) FILTER (WHERE scorer = 'bm25') AS bl, avg(score_gap) FILTER (WHERE scorer = 'bm25') AS bg, avg(long_pct) FILTER (WHERE scorer = 'rerank') AS rl, avg(score_gap) FILTER (WHERE scorer = 'rerank') AS rg FROM e)
SELECT round(bl, 6) AS bm25_long_pct, CAST(0 AS DOUBLE) AS bm25_multi_pct, round(bg, 6) AS bm25_score_gap, round(rl, 6) AS rerank_long_pct, CAST(0 AS DOUBLE) AS rerank_multi_pct, round(rg, 6) AS rerank_score_gap,
  round(rl - bl, 6) AS delta_long_pct, CAST(0 AS DOUBLE) AS delta_multi_pct, round(rg - bg, 6) AS delta_score_gap FROM m""",
    view=False,
)
def audit_summary(v: ChatView) -> DataFrame:
    """What reranking by length changes, on average over the queries."""
    return ranking.audit_summary(_audit(v), "bm25", "rerank")


@query(
    f"""WITH {_BM25_SQL} SELECT query_id, round(avg(n), 6) AS mean_context_tokens FROM (SELECT t.query_id, t.id, sum(len({_DOC_WORDS})) AS n FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM rr) t JOIN documents d ON d.doc_id BETWEEN t.id - 2 AND t.id + 2 WHERE t.rank <= 10 GROUP BY 1, 2) GROUP BY 1""",
    view=False,
)
def context_stats(v: ChatView) -> DataFrame:
    docs = v.doc_utterances.withColumns({"author_id": F.lit(1), "started_at": F.timestamp_seconds(F.lit(0))})
    return ranking.context_stats(ranking.with_context(_retrieved(v, docs), docs))


@query("SELECT CAST(sum(message_count) AS BIGINT) AS messages, count(*) AS utterances, round(avg(len(string_split(text, ' '))), 6) AS mean_tokens FROM utt")
def retrieve_stats(v: ChatView) -> DataFrame:
    return ranking.retrieve_stats(v.turns)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20", view=False)
def top_words(v: ChatView) -> DataFrame:
    return ranking.top_words(v.table("documents"))


# Searches ask every message whose id is divisible by 100 and that begins with two words, neither of them `or`. A query's
# form says how its words a and b are joined; forms: 0 a b, 1 "a b", 2 a or b, 3 a -b, 4 a alone.
_ASKED = rf"""asked AS (SELECT id AS query_id, FORM AS form, t[1] AS a, t[2] AS b FROM (SELECT id, {_TOKENS} AS t FROM messages WHERE id % 100 = 0) WHERE len(t) > 1 AND t[1] <> 'or' AND t[2] <> 'or')"""


def _full_text_sql(docs: str, form: str) -> str:
    """Tables asked and said (query_id, id, newer, rank) of a query over docs (id, newer, tokens)."""
    return f"""{_ASKED.replace("FORM", form)},
h AS ({docs}),
tok AS (SELECT id, unnest(tokens) AS term, unnest(range(1, len(tokens) + 1)) AS pos FROM h),
near_ AS (SELECT id, term, pos, lead(term) OVER (PARTITION BY id ORDER BY pos) AS next FROM tok),
occ AS (
  SELECT query_id, form, a, b, id, term, pos, next FROM asked JOIN near_ ON term = a
  UNION SELECT query_id, form, a, b, id, term, pos, next FROM asked JOIN near_ ON term = b WHERE form <> 4),
hit AS (SELECT query_id, id FROM occ GROUP BY query_id, id, form
  HAVING CASE form WHEN 0 THEN bool_or(term = a) AND bool_or(term = b) WHEN 1 THEN bool_or(term = a AND next = b) WHEN 2 THEN TRUE WHEN 3 THEN NOT bool_or(term = b) ELSE TRUE END),
spots AS (SELECT o.*, row_number() OVER w AS i FROM occ o SEMI JOIN hit USING (query_id, id) WHERE form <> 3 OR term = a WINDOW w AS (PARTITION BY query_id, id ORDER BY pos)),
ends_ AS (SELECT *, CASE WHEN form < 2 THEN CASE WHEN max(i) FILTER (WHERE term = a) OVER w IS NOT NULL AND max(i) FILTER (WHERE term = b) OVER w IS NOT NULL THEN least(max(i) FILTER (WHERE term = a) OVER w, max(i) FILTER (WHERE term = b) OVER w) END ELSE i END AS begin_ FROM spots WINDOW w AS (PARTITION BY query_id, id ORDER BY pos)),
found_ AS (SELECT e.query_id, e.id, e.pos, e.i, e.form, s.pos AS first_, e.begin_, lag(e.begin_) OVER (PARTITION BY e.query_id, e.id ORDER BY e.i) AS before
  FROM ends_ e JOIN spots s ON s.query_id = e.query_id AND s.id = e.id AND s.i = e.begin_),
covers AS (SELECT *, (first_ + pos) / 2.0 AS middle, greatest(0, (pos - first_) - (i - begin_)) AS between_ FROM found_ WHERE before IS NULL OR begin_ > before),
steps AS (SELECT *, middle - lag(middle) OVER (PARTITION BY query_id, id ORDER BY i) AS gap FROM covers),
sums AS (SELECT query_id, id, sum(0.1::DOUBLE / (1 + between_)) AS total, coalesce(sum(1.0::DOUBLE / gap) FILTER (WHERE gap > 0), 0) AS near_sum, count(*) AS n FROM steps GROUP BY query_id, id),
ranked AS (SELECT s.query_id, s.id, newer, round(CASE WHEN near_sum > 0 THEN total / (n / near_sum) ELSE total END, 9) AS rank FROM sums s JOIN h ON h.id = s.id),
said AS (SELECT query_id, id, round(rank, 6) AS rank FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, newer DESC, id) <= 20)"""


_LIVE_TOKENS = f"SELECT id, sent_us AS newer, {_TOKENS} AS tokens FROM messages WHERE NOT is_deleted AND in_memory_window AND text <> ''"


def _asked(v: ChatView, form: Column) -> DataFrame:
    """(query_id, form, a, b, query, text) of the messages that ask."""
    rows = v.messages.where("id % 100 = 0").select(F.col("id").alias("query_id"), form.alias("form"), "text", X.tokenize(F.col("text")).alias("t")).where("size(t) > 1 and t[0] <> 'or' and t[1] <> 'or'")
    a, b = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    forms = F.when(F.col("form") == 0, F.concat_ws(" ", a, b)).when(F.col("form") == 1, F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')))
    forms = forms.when(F.col("form") == 2, F.concat(a, F.lit(" or "), b)).when(F.col("form") == 3, F.concat(a, F.lit(" -"), b)).otherwise(a)
    return rows.withColumns({"a": a, "b": b, "query": forms})


_GRAMS = "list_distinct(flatten(list_transform({t}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


@query(f", {_full_text_sql(_LIVE_TOKENS, '4')} SELECT * FROM said")
def search_fts(v: ChatView) -> DataFrame:
    asked = _asked(v, F.lit(4)).select("query_id", "query")
    return search.search_fts(v.messages, v.chats, v.links.select("message_id", "episode_id"), asked).select("query_id", "id", "rank")


@query(f", {_full_text_sql(_LIVE_TOKENS, 'id // 100 % 4')} SELECT * FROM said")
def search_phrases(v: ChatView) -> DataFrame:
    """Two words, phrases, alternatives and exclusions with cover-density ranks."""
    asked = _asked(v, F.expr("id div 100 % 4")).select("query_id", "query")
    return search.search_fts(v.messages, v.chats, v.links.select("message_id", "episode_id"), asked).select("query_id", "id", "rank")


def _similar_sql(condition: str, limit: str) -> str:
    return rf""", s AS (SELECT m.id AS query_id, m.text AS query FROM messages m WHERE m.id % 100 = 0 AND m.text <> ''),
g AS (SELECT id, text, sent_us, {_GRAMS.format(t=_TOKENS)} AS g FROM messages WHERE NOT is_deleted AND in_memory_window AND text <> ''),
sg AS (SELECT query_id, query, {_GRAMS.format(t=_TOKENS.replace('text', 'query'))} AS g FROM s),
r AS (SELECT sg.query_id, g.id, g.sent_us, len(list_intersect(g.g, sg.g)) / len(list_distinct(list_concat(g.g, sg.g))) AS rank FROM g, sg WHERE {condition})
SELECT query_id, id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, sent_us DESC, id) AS n FROM r WHERE rank >= 0.3) WHERE n <= {limit}"""


def _samples(v: ChatView) -> DataFrame:
    return v.messages.where("id % 100 = 0 and text <> ''").select(F.col("id").alias("query_id"), F.col("text").alias("query"))


@query(_similar_sql("TRUE", "20"))
def search_trigram(v: ChatView) -> DataFrame:
    return search.search_trigram(v.messages, v.chats, v.links.select("message_id", "episode_id"), _samples(v)).select("query_id", "id", "rank")


@query(_similar_sql("g.text <> sg.query", "20"))
def find_similar(v: ChatView) -> DataFrame:
    return search.find_similar(v.messages, v.chats, v.links.select("message_id", "episode_id"), _samples(v)).select("query_id", "id", "rank")


@query(
    rf""", {_full_text_sql(_LIVE_TOKENS, 'id // 100 % 3')},
whole AS (SELECT query_id, form, concat('zzzq', a, ' ', m.text) AS query FROM asked JOIN messages m ON m.id = query_id WHERE form = 1),
g AS (SELECT id, newer, {_GRAMS.format(t='tokens')} AS g FROM h),
sg AS (SELECT query_id, {_GRAMS.format(t=_TOKENS.replace('text', 'query'))} AS g FROM whole),
like_ AS (SELECT sg.query_id, g.id, g.newer, len(list_intersect(g.g, sg.g)) / len(list_distinct(list_concat(g.g, sg.g))) AS rank FROM g, sg)
SELECT query_id, id, rank, 'fts' AS match_type FROM said SEMI JOIN (SELECT query_id FROM asked WHERE form = 0) USING (query_id)
UNION ALL SELECT query_id, id, round(rank, 6), 'trigram' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, newer DESC, id) AS k FROM like_ WHERE rank >= 0.3) WHERE k <= 20
UNION ALL SELECT query_id, id, CAST(0 AS DOUBLE), 'filter' FROM (SELECT query_id FROM asked WHERE form = 2), (SELECT id FROM messages WHERE NOT is_deleted AND in_memory_window ORDER BY sent_us DESC, id DESC LIMIT 20)"""
)
def search_messages(v: ChatView) -> DataFrame:
    """By id: two words, a whole text with a word that occurs nowhere, or blank."""
    asked = _asked(v, F.expr("id div 100 % 3"))
    words = F.when(F.col("form") == 0, F.col("query")).when(F.col("form") == 1, F.concat(F.lit("zzzq"), "a", F.lit(" "), "text")).otherwise(" ")
    return search.search_messages(v.messages, v.chats, v.links.select("message_id", "episode_id"), asked.select("query_id", words.alias("query"))).select("query_id", "id", "rank", "match_type")


@query(f", docs AS ({_EPISODE_DOCS}), {_full_text_sql(f'SELECT episode_id AS id, started_us AS newer, {_TOKENS.replace("text", "semantic_text")} AS tokens FROM docs JOIN episodes USING (episode_id)', 'id // 100 % 4')} SELECT query_id, id AS episode_id, rank FROM said")
def search_episodes(v: ChatView) -> DataFrame:
    docs = episodes.episode_docs(v.links.withColumnRenamed("telegram_id", "position"), v.messages, v.semantic)
    asked = _asked(v, F.expr("id div 100 % 4")).select("query_id", "query")
    return search.search_episodes(v.episodes, docs, v.chats, asked).select("query_id", "episode_id", "rank")


# vectors to make


@query("SELECT s.message_id FROM semantic s JOIN messages m ON m.id = s.message_id WHERE m.in_memory_window AND NOT m.is_deleted AND s.media_kind NOT IN ('sticker', 'voice', 'round') AND s.token_count >= 3 AND s.message_id % 2 = 1")
def pending_message_embeddings(v: ChatView) -> DataFrame:
    store = v.messages.where("id % 2 = 0").select(F.col("id").alias("message_id"), F.lit("a").alias("model"))
    return vectors.pending_message_embeddings(v.messages, v.semantic, store, "a").select("message_id")


@query("SELECT id AS message_id FROM messages WHERE text <> '' AND NOT is_deleted AND id % 2 = 1 ORDER BY sent_us DESC, id LIMIT 100")
def unembedded_messages(v: ChatView) -> DataFrame:
    store = v.messages.where("id % 2 = 0").select(F.col("id").alias("message_id"), F.lit("a").alias("model"))
    return vectors.unembedded_messages(v.messages, store, "a").select("message_id")


def _store(v: ChatView) -> DataFrame:
    return v.turns.where("first_message_id % 3 = 0").select("first_message_id", F.lit(120).alias("gap_seconds"), F.xxhash64("text").alias("text_hash"))


@query("SELECT first_message_id FROM utt WHERE length(text) // 4 >= 10 AND first_message_id % 3 <> 0")
def pending_utterance_embeddings(v: ChatView) -> DataFrame:
    return vectors.pending_utterance_embeddings(v.turns, _store(v), 120).select("first_message_id")


@query("SELECT count(*) AS utterances, count(*) FILTER (WHERE w) AS wanted, count(*) FILTER (WHERE w AND s) AS stored, count(*) FILTER (WHERE w AND NOT s) AS pending FROM (SELECT length(text) // 4 >= 10 AS w, first_message_id % 3 = 0 AS s FROM utt)")
def embedding_totals(v: ChatView) -> DataFrame:
    return vectors.embedding_totals(v.turns, _store(v))


@query(
    rf"""SELECT episode_id, CAST(len(list_filter(regexp_split_to_array(semantic_text, '{WHITE_CLASS}'), lambda x: x <> '')) AS BIGINT) AS token_count FROM ({_EPISODE_DOCS})
WHERE episode_id % 2 = 1 AND length(regexp_replace(semantic_text, '^{WHITE_CLASS}|{WHITE_CLASS}$', '', 'g')) >= 10 AND len(list_filter(regexp_split_to_array(semantic_text, '{WHITE_CLASS}'), lambda x: x <> '')) >= 5"""
)
def pending_episode_embeddings(v: ChatView) -> DataFrame:
    docs = episodes.episode_docs(v.links.withColumnRenamed("telegram_id", "position"), v.messages, v.semantic)
    store = v.episodes.where("episode_id % 2 = 0").select("episode_id", F.lit("a").alias("model"))
    return vectors.pending_episode_embeddings(docs, store, "a").select("episode_id", "token_count")


@query("SELECT first_message_id, CAST(length(text) AS DOUBLE) AS x, CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS DOUBLE) AS y FROM utt")
def embed_utterances(v: ChatView) -> DataFrame:
    """A stand-in embedder: length and vowels of the text."""
    made = vectors.embed(v.turns.select("first_message_id", "text"), lambda texts: [[len(t), sum(t.count(x) for x in "aeiou")] for t in texts])
    return made.select("first_message_id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


# prompts

_BUCKET = "CASE WHEN length(text) <= 10 THEN 'tiny' WHEN length(text) <= 50 THEN 'short' WHEN length(text) <= 200 THEN 'medium' WHEN length(text) <= 500 THEN 'long' ELSE 'very_long' END"


def _listed(kind: str, n: int, sep: str) -> str:
    """One row: the n most frequent items, noise left out of the first 2 n."""
    return rf"""(SELECT coalesce(string_agg(item, '{sep}' ORDER BY n DESC, item), '') FROM (SELECT item, n FROM (SELECT item, n FROM (SELECT i.item, count(*) AS n FROM items i JOIN messages m ON m.id = i.message_id
  WHERE i.signal_type = '{kind}' AND NOT m.is_deleted AND m.is_outgoing AND m.in_memory_window GROUP BY 1) ORDER BY n DESC, item LIMIT {2 * n})
  WHERE NOT regexp_full_match(item, '[{X.JOINERS}\x{{1F3FB}}-\x{{1F3FF}}]*') ORDER BY n DESC, item LIMIT {n}))"""


_SHARES = f"""shares AS (SELECT bucket, n / sum(n) OVER () AS share FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM messages
  WHERE NOT is_deleted AND is_outgoing AND in_memory_window AND text <> '' GROUP BY 1))"""
_LABELS = ", ".join(f"({k}, '{bucket}', '{label}')" for k, (bucket, label) in enumerate(prompts.LENGTHS))
@query(
    """SELECT c.conv_id AS query_id, concat('Текущий диалог:' || chr(10), string_agg(concat(CASE WHEN c.role = 'assistant' THEN 'он' ELSE 'собеседник' END, ': ', c.text, chr(10)), '' ORDER BY c.turn), chr(10),
  'Собеседник пишет ему: ', any_value(f.text), chr(10), 'Ответь от его лица.') AS prompt
FROM conversations c JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) f ON f.conv_id = c.conv_id GROUP BY c.conv_id""",
    view=False,
)
def build_prompts(v: ChatView) -> DataFrame:
    log = v.table("conversations")
    asked = log.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    dialog = log.select(F.col("conv_id").alias("query_id"), "turn", (F.col("role") == "assistant").alias("from_persona"), "text")
    none = v.utterances.where("false").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("memory"), "started_at", "chat_title", "text")
    return prompts.build_prompts(asked, none, dialog)


@query(
    rf""", asked AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.replace("text", "query")}) AS term FROM asked) GROUP BY ALL),
d AS (SELECT first_message_id AS id, {_TOKENS} AS tokens FROM utt),
c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), c GROUP BY query_id, id),
sz AS (SELECT first_message_id AS id, len({_DOC_WORDS}) AS words, is_outgoing, started_us, chat_id, text FROM utt),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(score * (least(words, 100) / (least(words, 100) + 10.0)), 6) AS score, words, is_outgoing, started_us, chat_id, text FROM bm JOIN sz USING (id) WHERE score > 0 AND words > 0) WHERE score > 0),
memories AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM hits WHERE rank <= 30 AND is_outgoing AND words >= 4),
known AS (SELECT query_id, string_agg(concat(k, '. [', strftime(make_timestamp(started_us), '%Y-%m'), ', чат «chat-', chat_id, '»]: ', text, chr(10)), '' ORDER BY k) AS lines FROM memories WHERE k <= 5 GROUP BY query_id),
said AS (SELECT conv_id AS query_id, string_agg(concat(CASE WHEN role = 'assistant' THEN 'он' ELSE 'собеседник' END, ': ', text, chr(10)), '' ORDER BY turn) AS lines FROM conversations GROUP BY conv_id)
SELECT a.query_id, concat(CASE WHEN k.lines IS NOT NULL THEN concat('{prompts.MEMORIES_HEAD.rstrip()}', chr(10), k.lines, chr(10)) ELSE '' END, 'Текущий диалог:', chr(10), s.lines, chr(10), 'Собеседник пишет ему: ', a.query, chr(10), 'Ответь от его лица.') AS prompt
FROM asked a JOIN said s USING (query_id) LEFT JOIN known k USING (query_id)"""
)
def ask_prompts(v: ChatView) -> DataFrame:
    """Every conversation asks with its first turn."""
    log = v.table("conversations")
    asked = log.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    dialog = log.select(F.col("conv_id").alias("query_id"), "turn", (F.col("role") == "assistant").alias("from_persona"), "text")
    turns = v.once("utterances", lambda: v.utterances)  # read for the words' counts, the scores and the memories
    return workloads.ask(asked, dialog, turns, lambda q, u: ranking.best_reranked(q, u, 30, 6))


@query(
    f""", {_BURSTS}, {_SHARES}, words AS (SELECT {_listed('slang_markers', 15, ', ')} AS slang, {_listed('emoji_usage', 10, ' ')} AS emoji)
SELECT concat_ws(chr(10),
  (SELECT concat('- Длина сообщений: ', string_agg(concat(printf('%.0f', share * 100), '% ', label), ', ' ORDER BY k)) FROM shares JOIN (VALUES {_LABELS}) t(k, bucket, label) USING (bucket) WHERE share >= 0.01),
  CASE WHEN avg_size > 0 THEN concat('- Сообщений подряд за один раз: обычно ', printf('%.0f', avg_size), ', максимум примерно ', printf('%.0f', p90_size)) END,
  CASE WHEN slang <> '' THEN concat('- Частые слова и сленг: ', slang) END, CASE WHEN emoji <> '' THEN concat('- Частые эмодзи: ', emoji) END) AS style_prompt FROM bursts, words"""
)
def style_prompt(v: ChatView) -> DataFrame:
    return prompts.style_prompt(reports.style_profile(v.messages, v.own_items)).select("style_prompt")


@query(
    r"""WITH RECURSIVE turns AS (SELECT conv_id, role = 'assistant' AS own, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g'), ' ') AS x, regexp_replace(text, '^WHITE|WHITE$', '', 'g') AS bare FROM conversations),
said AS (SELECT conv_id, list_slice(list({'x': x, 'bare': bare} ORDER BY i), -8, -1) AS seen FROM turns WHERE own GROUP BY conv_id),
fold AS (
  SELECT t.conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS kept, list_append(coalesce(s.seen, []), {'x': t.x, 'bare': t.bare}) AS seen FROM turns t LEFT JOIN said s ON s.conv_id = t.conv_id WHERE t.i = 1
  UNION ALL
  SELECT conv_id, i, CASE WHEN old THEN kept ELSE kept + 1 END, CASE WHEN old THEN seen ELSE list_append(seen, {'x': x, 'bare': bare}) END FROM (
    SELECT t.conv_id, t.i, t.x, t.bare, f.kept, f.seen, len(list_filter(f.seen, lambda s: CASE WHEN s.x = '' OR t.x = '' THEN s.bare = t.bare
        WHEN strlen(t.x) > strlen(s.x) THEN contains(t.x, s.x) AND length(s.x) * 10 >= length(t.x) * 6 ELSE contains(s.x, t.x) AND length(t.x) * 10 >= length(s.x) * 6 END)) > 0 AS old
    FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.i = f.i + 1))
SELECT conv_id, max(i) AS lines, max(kept) AS kept FROM fold GROUP BY conv_id""".replace("WHITE", WHITE_CLASS),
    view=False,
)
def drop_repeats(v: ChatView) -> DataFrame:
    log = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = log.select(
        "conv_id", F.get("t", F.lit(0))["text"].alias("query"), F.transform("t", lambda x: F.struct((x["role"] == "assistant").alias("from_persona"), x["text"].alias("text"))).alias("history"), F.transform("t", lambda x: x["text"]).alias("messages")
    )
    return prompts.drop_repeats(rows).select("conv_id", F.size("messages").alias("lines"), F.size("kept").alias("kept"))


@query(
    rf"""SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WHITE_CLASS}|{WHITE_CLASS}$', '', 'g')), lambda x: x <> ''), 1, 6) AS lines
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(text, '. ', chr(10)) ELSE replace(text, chr(10), ' ') END AS text FROM conversations)""",
    view=False,
)
def parse_replies(v: ChatView) -> DataFrame:
    """Replies of even turns as JSON with a line for each sentence, of odd turns as plain text of one line."""
    text = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.array(F.replace("text", F.lit(". "), F.lit("\n"))).alias("messages")))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    return v.table("conversations").select("conv_id", "turn", X.parse_reply_messages(text).alias("lines"))


# sources


@query(
    """SELECT id, CASE WHEN media_kind <> 'sticker' AND id % 7 = 0 THEN 'document' ELSE media_kind END AS kind,
  CASE WHEN id % 3 = 0 THEN sender_id WHEN chat_id % 5 = 1 THEN CASE WHEN is_outgoing THEN -1 ELSE chat_id END END AS sender FROM messages"""
)
def classify_records(v: ChatView) -> DataFrame:
    """Raw media and peers made of the messages: each seventh document has no attribute that decides."""
    kind = F.col("media_kind")
    a = lambda name, voice, round_: F.struct(F.lit(name).alias("kind"), F.lit(voice).alias("voice"), F.lit(round_).alias("round"))
    other = [a("filename", False, False), a("audio", False, False)]
    attributes = F.when(kind == "sticker", F.array(*other, a("sticker", False, False))).when(F.col("id") % 7 == 0, F.array(*other)).when(kind == "voice", F.array(*other, a("audio", True, False))).when(kind == "round", F.array(*other, a("video", False, True)))
    media = F.when((kind == "sticker") | (F.col("id") % 7 == 0) | kind.isin("voice", "round"), "document").otherwise(kind)
    peer = F.when(F.col("chat_id") % 5 == 1, "user").otherwise("channel")
    sender = records.resolve_sender(F.when(F.col("id") % 3 == 0, F.col("sender_id")), peer, F.col("chat_id"), F.col("is_outgoing"), F.lit(-1).cast("long"))
    return v.messages.select("id", records.classify_media(media, F.coalesce(attributes, F.array().cast("array<struct<kind:string,voice:boolean,round:boolean>>"))).alias("kind"), sender.alias("sender"))


@query("SELECT id, type, CASE WHEN type = 'saved_messages' THEN 'Saved Messages' ELSE title END AS title, type = 'private' AND is_bot AS is_bot, type NOT IN ('saved_messages', 'private') AND is_creator AS is_creator, type NOT IN ('saved_messages', 'private') AND is_admin AS is_admin FROM dialogs")
def classify_dialog(v: ChatView) -> DataFrame:
    t = F.col("type")
    user = t.isin("saved_messages", "private")
    peers = v.dialogs.select(
        F.when(user, "user").when(t == "group", "chat").otherwise("channel").alias("peer_kind"), "id", (t == "saved_messages").alias("is_self"), F.when(user, F.col("title")).alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.when(~user, F.col("title")).alias("title"), F.lit(None).cast("string").alias("username"), F.col("is_bot").alias("bot"), F.col("is_creator").alias("creator"), F.col("is_admin").alias("admin_rights"), (t == "supergroup").alias("megagroup"),
    )
    return records.classify_dialog(peers).drop("username")


@query("SELECT telegram_id, chat_id, sender_id, reply_to_id, text, media_kind, sent_us // 1000000 * 1000000 AS sent_at, is_outgoing, is_forwarded, edit_us // 1000000 * 1000000 AS edit_date FROM messages")
def read_messages(v: ChatView) -> DataFrame:
    """The messages as raw JSON lines, written and read back."""
    seconds = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    raw = v.messages.select(
        "telegram_id", "chat_id", "sender_id", F.coalesce("reply_to_id", F.lit(0)).alias("reply_to_id"), "text", "media_kind", F.expr("sent_us div 1000000").alias("sent_at"), "is_outgoing", "is_forwarded", F.expr("coalesce(edit_us div 1000000, 0)").alias("edit_date"),
    )
    path = scratch.new_dir(v.spark, "raw-records")
    raw.write.json(path)
    return records.read_messages(v.spark, path).select("telegram_id", "chat_id", "sender_id", "reply_to_id", "text", "media_kind", "sent_at", "is_outgoing", "is_forwarded", "edit_date")


_LINES = ("concat('{\"telegram_id\":', telegram_id)", "concat('{\"telegram_id\":', telegram_id, '}')", "concat('{\"telegram_id\":', telegram_id, ',\"chat_id\":', chat_id, '}')")


@query(f"SELECT CASE telegram_id % 3 WHEN 0 THEN {_LINES[0]} ELSE {_LINES[1]} END AS line FROM messages WHERE telegram_id % 3 < 2")
def broken_records(v: ChatView) -> DataFrame:
    """Lines cut short and lines without a chat, written beside good ones."""
    path = scratch.new_dir(v.spark, "broken-records")
    v.messages.select(F.expr(f"CASE telegram_id % 3 WHEN 0 THEN {_LINES[0]} WHEN 1 THEN {_LINES[1]} ELSE {_LINES[2]} END").alias("value")).write.text(path)
    return records.broken_records(v.spark, path)


@query("SELECT id, chat_id, CASE WHEN id % 2 = 0 THEN 'second' ELSE 'first' END AS state FROM messages WHERE id % 2 = 0 OR id % 3 = 0")
def write_layers(v: ChatView) -> DataFrame:
    """A layer written twice; the second writing replaces its buckets, so the rows to keep come with it."""
    path = scratch.new_dir(v.spark, "layer")
    m = v.messages.where("id % 2 = 0 or id % 3 = 0").select("id", "chat_id")
    records.write_layer(m.withColumn("state", F.lit("first")), path)
    records.write_layer(m.withColumn("state", F.when(F.col("id") % 2 == 0, "second").otherwise("first")), path)
    return v.spark.read.parquet(path).select("id", "chat_id", "state")


@query("SELECT id, chat_id, telegram_id, CASE WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS state FROM messages WHERE id % 2 = 0 OR id % 3 = 0")
def layer_store(v: ChatView) -> DataFrame:
    """Two batches that share buckets; the first comes again after the second, and changes nothing."""
    kept = store.LayerStore(v.spark, scratch.new_dir(v.spark, "store"), ["chat_id", "telegram_id"], ["state"], "chat_id")
    m = v.messages.select("id", "chat_id", "telegram_id")
    first, second = m.where("id % 2 = 0").withColumn("state", F.lit("first")), m.where("id % 3 = 0").withColumn("state", F.lit("second"))
    for batch, number in ((first, 1), (second, 2), (first, 1), (second, 2)):
        kept.merge(batch, number)
    return kept.read().select("id", "chat_id", "telegram_id", "state")


# streams


def _streamed(v: ChatView, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the stored messages has given out when all of them are read."""
    where = scratch.new_dir(v.spark, f"stream-{name}")
    source = scratch.new_dir(v.spark, f"stream-{name}-in")
    v.messages.write.parquet(source)
    out = make(ingest.stream_messages(v.spark, source, v.messages.schema))
    out.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(out.schema).parquet(f"{where}/rows")


@query("SELECT message_id, normalized_text, language, token_count, media_kind IN ('sticker', 'voice', 'round') OR token_count < 3 AS skip_embedding FROM semantic")
def stream_semantic(v: ChatView) -> DataFrame:
    return _streamed(v, "semantic", ingest.semantic_stream)


@query(f", {_KINDS} SELECT signal_type, count(*) AS n, count(DISTINCT v) AS values FROM kinds GROUP BY 1")
def stream_signals(v: ChatView) -> DataFrame:
    return _streamed(v, "signals", ingest.signal_stream).groupBy("signal_type").agg(F.count("*").alias("n"), F.count_distinct("value_json").alias("values"))


@query("SELECT id, chat_id, telegram_id FROM messages")
def stream_dedup(v: ChatView) -> DataFrame:
    """Every message delivered twice comes out once; nothing is late within a hundred years."""
    twice = lambda m: m.select("id", "chat_id", "telegram_id", "sent_at", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _streamed(v, "dedup", lambda m: ingest.stream_dedup(twice(m), "876000 hours")).select("id", "chat_id", "telegram_id")


@query(f", {_KINDS} SELECT s.message_id, s.normalized_text, s.token_count, (SELECT count(*) FROM kinds) AS signals FROM semantic s")
def stream_store(v: ChatView) -> DataFrame:
    """Layers of a stream of several batches, merged into their stores."""
    where, files = scratch.new_dir(v.spark, "stream-store"), v.messages.inputFiles()
    source = files[0].rsplit("/", 1)[0]  # the view's messages are files already
    if len(files) < 3:
        source, files = scratch.new_dir(v.spark, "stream-store-in"), [""] * 3
        v.messages.repartition(3).write.parquet(source)
    stores = ingest.store_layers(v.messages, f"{where}/layers")
    stream = ingest.stream_messages(v.spark, source, v.messages.schema, files_per_batch=-(-len(files) // 3))
    stream.writeStream.foreachBatch(ingest.layers_sink(stores)).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    signals = stores["signals"].read().agg(F.count("*").alias("signals"))
    return stores["semantic"].read().select("message_id", "normalized_text", "token_count").crossJoin(F.broadcast(signals))  # one row


# a stream's watermark when all is read: the latest time less the lateness, in whole milliseconds
_MARK = "mark AS (SELECT max(sent_us) // 1000 * 1000 - 600000000 AS mark FROM ROWS)"


@query(
    f""", {_MARK.replace("ROWS", "messages")},
runs AS (SELECT *, sum(new_) OVER (PARTITION BY chat_id, sender_id ORDER BY sent_us, id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT chat_id, sender_id, id, sent_us, CASE WHEN sent_us - lag(sent_us) OVER (PARTITION BY chat_id, sender_id ORDER BY sent_us, id) <= 120000000 THEN 0 ELSE 1 END AS new_ FROM messages))
SELECT chat_id, sender_id, min(sent_us) AS started_at, max(sent_us) + 120000000 AS ended_at, count(*) AS n FROM runs, mark GROUP BY chat_id, sender_id, g, mark HAVING max(sent_us) + 120000000 <= mark"""
)
def stream_burst_counts(v: ChatView) -> DataFrame:
    """Sessions that the watermark has closed."""
    return _streamed(v, "bursts", ingest.stream_burst_counts)


@query(
    f""", {_MARK.replace("ROWS", "inp")},
after_ AS (SELECT u.*, (SELECT min(i.sent_us) FROM inp i WHERE i.chat_id = u.chat_id AND i.sent_us > u.ended_us) AS next_us FROM utt u)
SELECT chat_id, first_message_id, author_id, is_outgoing, started_us, ended_us, message_count, text, voice_count FROM after_, mark WHERE next_us < mark OR ended_us + 120000000 < mark"""
)
def stream_utterances(v: ChatView) -> DataFrame:
    """Turns that the next message or the watermark has closed."""
    where, source = scratch.new_dir(v.spark, "stream-turns"), scratch.new_dir(v.spark, "stream-turns-in")
    rows = v.utterance_input.select("chat_id", "id", "telegram_id", "author_id", "sent_at", "normalized_text", "token_count", "is_outgoing", "media_kind")
    rows.write.parquet(source)
    out = ingest.stream_utterances(ingest.stream_messages(v.spark, source, rows.schema))
    out.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(out.schema).parquet(f"{where}/rows")


# reports

_R = "FROM messages m JOIN chats c ON c.id = m.chat_id LEFT JOIN links l ON l.message_id = m.id"


@query(
    f"""SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, count(*) AS total, count(*) FILTER (WHERE m.is_outgoing) AS outgoing,
  count(*) FILTER (WHERE m.is_forwarded) AS forwarded, count(*) FILTER (WHERE m.edit_us IS NOT NULL) AS edited, count(DISTINCT l.episode_id) AS episodes
{_R} WHERE NOT m.is_deleted AND m.in_memory_window GROUP BY 1, 2, 3, 4"""
)
def chat_report(v: ChatView) -> DataFrame:
    return reports.chat_report(v.messages, v.chats, v.links)


@query("SELECT chat_id, (sent_us // 3600000000) % 24 AS hour, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing GROUP BY 1, 2")
def hour_distribution(v: ChatView) -> DataFrame:
    return reports.hour_distribution(v.messages)


@query(f"SELECT chat_id, {_BUCKET} AS bucket, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing AND text <> '' GROUP BY 1, 2")
def length_distribution(v: ChatView) -> DataFrame:
    return reports.length_distribution(v.messages)


def _top_items(kind: str) -> str:
    return f"""SELECT chat_id, item, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, item) AS rank FROM (
  SELECT m.chat_id, i.item, count(*) AS n FROM items i JOIN messages m ON m.id = i.message_id WHERE i.signal_type = '{kind}' AND NOT m.is_deleted AND m.is_outgoing AND m.in_memory_window GROUP BY 1, 2)) WHERE rank <= 10"""


@query(_top_items("emoji_usage"))
def top_emoji(v: ChatView) -> DataFrame:
    return reports.top_signals(v.messages, v.own_items, "emoji_usage")


@query(_top_items("slang_markers"))
def top_slang(v: ChatView) -> DataFrame:
    return reports.top_signals(v.messages, v.own_items, "slang_markers")


@query(
    """SELECT chat_id, emoticon, n, total, rank FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY chat_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, emoticon) AS rank FROM (
  SELECT chat_id, coalesce(sticker_emoticon, '') AS emoticon, count(*) AS n FROM messages WHERE media_kind = 'sticker' AND NOT is_deleted AND is_outgoing AND in_memory_window GROUP BY 1, 2)) WHERE rank <= 10 AND emoticon <> ''"""
)
def top_stickers(v: ChatView) -> DataFrame:
    return reports.top_stickers(v.messages)


@query(
    f"""SELECT r.*, h.hour AS peak_hour, b.bucket AS dominant_length FROM (
  SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, count(*) AS total, count(*) FILTER (WHERE m.is_outgoing) * 100 // count(*) AS outgoing_pct, count(DISTINCT l.episode_id) AS episodes
  {_R} WHERE NOT m.is_deleted AND m.in_memory_window GROUP BY 1, 2, 3, 4) r
LEFT JOIN (SELECT chat_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, hour) AS k FROM (
  SELECT chat_id, (sent_us // 3600000000) % 24 AS hour, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing GROUP BY 1, 2)) WHERE k = 1) h ON h.chat_id = r.chat_id
LEFT JOIN (SELECT chat_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, bucket) AS k FROM (
  SELECT chat_id, {_BUCKET} AS bucket, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing AND text <> '' GROUP BY 1, 2)) WHERE k = 1) b ON b.chat_id = r.chat_id"""
)
def chat_overview(v: ChatView) -> DataFrame:
    return reports.chat_overview(v.messages, v.chats, v.links)


def _json_map(key: str, value: str, rows: str, name: str) -> str:
    pair = f"""concat('"', CAST({key} AS VARCHAR), '":', CAST({value} AS VARCHAR))"""
    return f"LEFT JOIN (SELECT chat_id, concat('{{', string_agg({pair}, ',' ORDER BY {key}), '}}') AS {name} FROM ({rows}) GROUP BY chat_id) {name}_ ON {name}_.chat_id = r.chat_id"


_REPORT = f"""SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, count(*) AS total, count(*) FILTER (WHERE m.is_outgoing) AS outgoing,
  count(*) FILTER (WHERE m.is_forwarded) AS forwarded, count(*) FILTER (WHERE m.edit_us IS NOT NULL) AS edited, count(DISTINCT l.episode_id) AS episodes
{_R} WHERE NOT m.is_deleted AND m.in_memory_window GROUP BY 1, 2, 3, 4"""
_STICKERS = """SELECT chat_id, emoticon, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY chat_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, emoticon) AS rank FROM (
  SELECT chat_id, coalesce(sticker_emoticon, '') AS emoticon, count(*) AS n FROM messages WHERE media_kind = 'sticker' AND NOT is_deleted AND is_outgoing AND in_memory_window GROUP BY 1, 2)) WHERE rank <= 10 AND emoticon <> ''"""


@query(
    f"""SELECT r.*, hours, lengths, emoji, slang, stickers, sticker_total FROM ({_REPORT}) r
{_json_map('hour', 'n', 'SELECT chat_id, (sent_us // 3600000000) % 24 AS hour, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing GROUP BY 1, 2', 'hours')}
{_json_map('bucket', 'n', f"SELECT chat_id, {_BUCKET} AS bucket, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing AND text <> '' GROUP BY 1, 2", 'lengths')}
{_json_map('item', 'n', _top_items('emoji_usage'), 'emoji')}
{_json_map('item', 'n', _top_items('slang_markers'), 'slang')}
{_json_map('emoticon', 'n', _STICKERS, 'stickers')}
LEFT JOIN (SELECT chat_id, max(total) AS sticker_total FROM ({_STICKERS}) GROUP BY chat_id) t ON t.chat_id = r.chat_id"""
)
def personality_report(v: ChatView) -> DataFrame:
    out = reports.personality_report(v.messages, v.chats, v.links, v.own_items)
    return out.select(*[F.to_json(c).alias(c) if c in ("hours", "lengths", "emoji", "slang", "stickers") else F.col(c) for c in out.columns])


@query(
    f"SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM messages WHERE NOT is_deleted AND is_outgoing AND in_memory_window AND text <> '' GROUP BY 1)"
)
def style_length_shares(v: ChatView) -> DataFrame:
    return reports.style_length_shares(v.messages)


@query(
    """SELECT item, n FROM (SELECT item, n FROM (SELECT i.item, count(*) AS n FROM items i JOIN messages m ON m.id = i.message_id
  WHERE i.signal_type = 'slang_markers' AND NOT m.is_deleted AND m.is_outgoing AND m.in_memory_window GROUP BY 1) ORDER BY n DESC, item LIMIT 30) ORDER BY n DESC, item LIMIT 15"""
)
def style_top_slang(v: ChatView) -> DataFrame:
    return reports.style_top_items(v.messages, v.own_items, "slang_markers", 15)


@query(
    f""", {_BURSTS}, {_SHARES} SELECT bursts.*, {", ".join(f"(SELECT round(share, 6) FROM shares WHERE bucket = '{b}') AS {b}" for b, _ in prompts.LENGTHS)},
  {_listed('slang_markers', 15, ' ')} AS slang, {_listed('emoji_usage', 10, ' ')} AS emoji FROM bursts"""
)
def style_profile(v: ChatView) -> DataFrame:
    p = reports.style_profile(v.messages, v.own_items)
    p = p.withColumns({b: F.col("length_shares")[b] for b, _ in prompts.LENGTHS} | {"slang": F.array_join("slang", " "), "emoji": F.array_join("emoji", " ")})
    return p.drop("length_shares")


@query(
    """SELECT * FROM (SELECT count(*) AS messages, count(*) FILTER (WHERE in_memory_window) AS in_window, count(*) FILTER (WHERE is_outgoing) AS outgoing FROM messages WHERE NOT is_deleted),
  (SELECT count(*) AS episodes, round(coalesce(avg(message_count), 0), 6) AS avg_episode_size FROM episodes), (SELECT count(*) AS signals FROM (SELECT DISTINCT signal_type, message_id FROM items))"""
)
def validation_stats(v: ChatView) -> DataFrame:
    listed = v.signals.where(F.col("signal_type").isin("emoji_usage", "slang_markers"))
    return reports.validation_stats(v.messages, v.chats, v.episodes, listed)


@query("SELECT personality_surface, count(*) AS chats FROM chats GROUP BY 1")
def chats_by_surface(v: ChatView) -> DataFrame:
    return reports.chats_by_surface(v.chats)


@query("SELECT id AS chat_id, title, personality_surface, round(relevance_score, 6) AS relevance_score FROM chats WHERE relevance_score > 0.8 AND id NOT IN (SELECT chat_id FROM messages WHERE NOT is_deleted)")
def empty_high_score_chats(v: ChatView) -> DataFrame:
    return reports.empty_high_score_chats(v.messages, v.chats)


@query(
    """, m_ AS (SELECT count(*) AS m, count(*) FILTER (WHERE in_memory_window) AS w, count(*) FILTER (WHERE in_memory_window AND telegram_id % 20 = 1) AS few FROM messages WHERE NOT is_deleted),
e_ AS (SELECT count(*) AS e, count(*) FILTER (WHERE episode_id % 1000000 = 0) AS heads FROM episodes),
s_ AS (SELECT count(*) AS s FROM items),
x_ AS (SELECT count(*) AS x FROM chats WHERE relevance_score > 0.8 AND id NOT IN (SELECT chat_id FROM messages WHERE NOT is_deleted)),
variants AS (
  SELECT 'whole' AS variant, m, w, s, e, x FROM m_, e_, s_, x_ UNION ALL SELECT 'narrow', m, few, s, e, x FROM m_, e_, s_, x_ UNION ALL SELECT 'wide', m, m, s, e, x FROM m_, e_, s_, x_
  UNION ALL SELECT 'bare', m, w, 0, 0, x FROM m_, x_ UNION ALL SELECT 'sparse', m, w, s, heads, x FROM m_, e_, s_, x_ UNION ALL SELECT 'kept', m, w, s, e, 0 FROM m_, e_, s_),
rules AS (SELECT variant, unnest([
  CASE WHEN m > 0 AND 100.0 * w / m < 10 THEN 'few_in_window' END, CASE WHEN m > 0 AND 100.0 * w / m > 95 THEN 'nearly_all_in_window' END, CASE WHEN s = 0 THEN 'no_signals' END,
  CASE WHEN m > 100 AND e = 0 THEN 'no_episodes' END, CASE WHEN m > 500 AND e > 0 AND e / m < 0.005 THEN 'few_episodes' END, CASE WHEN x > 0 THEN 'empty_high_score_chats' END]) AS warning FROM variants)
SELECT variant, warning FROM rules WHERE warning IS NOT NULL"""
)
def validation_warnings(v: ChatView) -> DataFrame:
    """The stored layers as they are, and with each fault that a rule looks for."""
    m, c, e, s = v.messages, v.chats, v.episodes, v.signals
    none = F.lit(False)
    variants = {
        "whole": (m, c, e, s),
        "narrow": (m.withColumn("in_memory_window", F.expr("in_memory_window and telegram_id % 20 = 1")), c, e, s),
        "wide": (m.withColumn("in_memory_window", F.lit(True)), c, e, s),
        "bare": (m, c, e.where(none), s.where(none)),
        "sparse": (m, c, e.where("episode_id % 1000000 = 0"), s),
        "kept": (m, c.join(m.where("not is_deleted").select(F.col("chat_id").alias("id")).distinct(), "id", "left_semi"), e, s),
    }
    found = [reports.validation_warnings(*layers_).select(F.lit(name).alias("variant"), "warning") for name, layers_ in variants.items()]
    return reduce(DataFrame.union, found)


_INSPECT = """SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, count(m.id) AS total, count(*) FILTER (WHERE m.is_outgoing) AS outgoing,
  count(*) FILTER (WHERE m.in_memory_window) AS in_window{more}, count(DISTINCT l.episode_id) AS episodes
FROM chats c LEFT JOIN messages m ON m.chat_id = c.id AND NOT m.is_deleted LEFT JOIN links l ON l.message_id = m.id GROUP BY 1, 2, 3, 4"""


@query(_INSPECT.format(more=", count(*) FILTER (WHERE m.is_outgoing AND m.in_memory_window) AS outgoing_in_window, count(*) FILTER (WHERE NOT m.is_outgoing AND m.in_memory_window) AS incoming_in_window"))
def chat_inspect(v: ChatView) -> DataFrame:
    return reports.chat_inspect(v.messages, v.chats, v.links)


@query(_INSPECT.format(more="") + " ORDER BY total DESC, chat_id LIMIT 5")
def top_chats(v: ChatView) -> DataFrame:
    return reports.top_chats(v.messages, v.chats, v.links, 5)


@query("SELECT c.id AS chat_id, coalesce(min(message_count), 0) AS min_size, round(coalesce(avg(message_count), 0), 6) AS avg_size, coalesce(max(message_count), 0) AS max_size FROM chats c LEFT JOIN episodes e ON e.chat_id = c.id GROUP BY 1")
def episode_sizes(v: ChatView) -> DataFrame:
    return reports.episode_sizes(v.episodes, v.chats)


@query("SELECT chat_id, episode_id, message_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_count DESC, episode_id) AS rank FROM episodes) WHERE rank <= 5")
def largest_episodes(v: ChatView) -> DataFrame:
    return reports.largest_episodes(v.episodes).select("chat_id", "episode_id", "message_count", "rank")


_VOLUMES = "count(*) AS total, count(*) FILTER (WHERE in_memory_window) AS in_window, count(*) FILTER (WHERE is_outgoing) AS outgoing"


@query(f"SELECT CASE WHEN media_kind = '' THEN 'text' ELSE media_kind END AS kind, {_VOLUMES} FROM messages WHERE NOT is_deleted GROUP BY 1")
def media_kinds(v: ChatView) -> DataFrame:
    return reports.media_kinds(v.messages)


@query(f"SELECT {_VOLUMES} FROM messages WHERE NOT is_deleted AND media_kind = 'round'")
def media_kind_totals(v: ChatView) -> DataFrame:
    return reports.media_kind_totals(v.messages, "round")


@query(
    f"SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, {_VOLUMES} FROM messages m JOIN chats c ON c.id = m.chat_id WHERE NOT is_deleted AND media_kind = 'photo' AND personality_surface = 'social' GROUP BY 1, 2, 3, 4 ORDER BY total DESC, chat_id LIMIT 5"
)
def media_top_chats(v: ChatView) -> DataFrame:
    return reports.media_top_chats(v.messages, v.chats, "photo", "social")


@query("SELECT sticker_emoticon AS emoticon, count(*) AS n FROM messages WHERE NOT is_deleted AND media_kind = 'sticker' AND sticker_emoticon <> '' GROUP BY 1 ORDER BY n DESC, emoticon LIMIT 10")
def top_emoticons(v: ChatView) -> DataFrame:
    return reports.top_emoticons(v.messages)


@query("SELECT personality_surface, count(*) AS total, count(*) FILTER (WHERE in_memory_window) AS in_window FROM messages m JOIN chats c ON c.id = m.chat_id WHERE NOT is_deleted AND media_kind = 'sticker' GROUP BY 1")
def media_by_surface(v: ChatView) -> DataFrame:
    return reports.media_by_surface(v.messages, v.chats, "sticker")


@query(f"SELECT c.id AS chat_id, c.title, c.personality_surface, round(c.relevance_score, 6) AS relevance_score, {_VOLUMES} FROM messages m JOIN chats c ON c.id = m.chat_id WHERE NOT is_deleted AND media_kind = 'voice' GROUP BY 1, 2, 3, 4 ORDER BY total DESC, chat_id LIMIT 20")
def voice_top_chats(v: ChatView) -> DataFrame:
    return reports.voice_top_chats(v.messages, v.chats)


def _log(v: ChatView) -> DataFrame:
    at = F.col("conv_id") * 3_600_000_000 + F.col("turn") * 60_000_000
    return v.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("user_id"), F.col("conv_id").alias("chat_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("u"), F.col("conv_id").cast("string"))).otherwise("").alias("username"), (F.col("role") == "assistant").alias("from_persona"), "text", F.timestamp_micros(at).alias("created_at"),
    )


@query("SELECT conv_id AS user_id, max(CASE WHEN conv_id % 2 = 0 THEN concat('u', CAST(conv_id AS VARCHAR)) END) AS username, count(*) AS messages, max(conv_id * 3600000000 + turn * 60000000) AS last_at FROM conversations GROUP BY 1", view=False)
def bot_dialogs(v: ChatView) -> DataFrame:
    return reports.bot_dialogs(_log(v))


@query("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 3", view=False)
def bot_dialog(v: ChatView) -> DataFrame:
    return reports.bot_dialog(_log(v), 3, 3).select("id", "text")


@query(
    """SELECT id, chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS turn FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2""",
    view=False,
)
def dialog_history(v: ChatView) -> DataFrame:
    return reports.dialog_history(_log(v), 2).select("id", "chat_id", "turn")


@query("SELECT message_id FROM (SELECT DISTINCT i.message_id, m.sent_us FROM items i JOIN messages m ON m.id = i.message_id WHERE signal_type = 'slang_markers') ORDER BY sent_us DESC, message_id DESC LIMIT 100")
def signals_by_type(v: ChatView) -> DataFrame:
    return reports.signals_by_type(v.signals, v.messages, "slang_markers").select("message_id")


@query()
def sync_workload(v: ChatView) -> DataFrame:
    """The ingest workload from an empty store: rows of each layer."""
    stored = v.messages.where("false")
    memory, marks = workloads.sync(v.dialogs, v.messages, stored, v.spark.createDataFrame([], "chat_id long, last_message_id long"))
    parts = {"messages": memory.messages, "semantic": memory.semantic, "signals": memory.signals, "episodes": memory.episodes, "links": memory.links, "docs": memory.docs, "cursors": marks}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
        out = n if out is None else out.union(n)
    return out


def _run(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _plain(build(ChatView(spark, sf_dir)))


QUERIES = {name: _run(build) for name, (build, _) in _FOUND.items()}
ORACLE = {name: sql for name, (_, sql) in _FOUND.items() if sql}
