"""Counts, rankings and reports over chats, messages, signals and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .sessions import burst_stats

_CHAT = ("chat_id", "title", "personality_surface", "relevance_score")


def _chats(chats: DataFrame) -> DataFrame:
    return chats.select(F.col("id").alias("chat_id"), "title", "personality_surface", "relevance_score")


def _live(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("is_deleted"))


def _remembered(messages: DataFrame) -> DataFrame:
    return _live(messages).where("in_memory_window")


def _with_episode(messages: DataFrame, links: DataFrame) -> DataFrame:
    return messages.join(links.select(F.col("message_id").alias("id"), "episode_id"), "id", "left")


def _edited(messages: DataFrame) -> Column:
    return F.col("edit_us" if "edit_us" in messages.columns else "edit_date").isNotNull()


def chat_report(messages: DataFrame, chats: DataFrame, links: DataFrame) -> DataFrame:
    """Per chat over live in-window messages: total, outgoing, forwarded, edited, episodes."""
    counts = (
        _with_episode(_remembered(messages), links)
        .groupBy("chat_id")
        .agg(
            F.count("*").alias("total"), F.count_if("is_outgoing").alias("outgoing"), F.count_if("is_forwarded").alias("forwarded"), F.count_if(_edited(messages)).alias("edited"), F.count_distinct("episode_id").alias("episodes")
        )
    )
    return _chats(chats).join(counts, "chat_id").orderBy(F.col("relevance_score").desc(), "chat_id")


def hour_distribution(messages: DataFrame) -> DataFrame:
    """Live outgoing messages by (chat, hour), whether in the window or not."""
    return _live(messages).where("is_outgoing").groupBy("chat_id", X.hour_of_day(F.col("sent_at")).alias("hour")).agg(F.count("*").alias("n"))


def length_distribution(messages: DataFrame) -> DataFrame:
    """Live outgoing messages with text by (chat, length bucket), whether in the window or not."""
    rows = _live(messages).where(F.col("is_outgoing") & (F.col("text") != ""))
    return rows.groupBy("chat_id", X.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


def _items(messages: DataFrame, signals: DataFrame, signal_type: str) -> DataFrame:
    own = _remembered(messages).where("is_outgoing").select(F.col("id").alias("message_id"), "chat_id")
    rows = signals.where(F.col("signal_type") == signal_type).join(own, "message_id")
    return rows.select("chat_id", F.explode(F.from_json("value_json", "array<string>")).alias("item"))


def top_signals(messages: DataFrame, signals: DataFrame, signal_type: str, n: int = 10) -> DataFrame:
    """Each chat's n most frequent items of an array signal; noise is taken out afterwards, so fewer may stay."""
    counts = _items(messages, signals, signal_type).groupBy("chat_id", "item").agg(F.count("*").alias("n"))
    w = Window.partitionBy("chat_id").orderBy(F.col("n").desc(), "item")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.where(~X.is_emoji_noise(F.col("item")))


def _emoticon(messages: DataFrame) -> Column:
    return F.coalesce(F.col("sticker_emoticon") if "sticker_emoticon" in messages.columns else F.col("sticker_meta.Emoticon"), F.lit(""))


def top_stickers(messages: DataFrame, n: int = 10) -> DataFrame:
    """Each chat's n most frequent emoticons of own stickers and the chat's total; the blank one is ranked but hidden."""
    rows = _remembered(messages).where(F.col("is_outgoing") & (F.col("media_kind") == "sticker"))
    counts = rows.groupBy("chat_id", _emoticon(messages).alias("emoticon")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("chat_id")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.col("n").desc(), "emoticon"))})
    return ranked.where((F.col("rank") <= n) & (F.col("emoticon") != ""))


def _map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    entry = F.struct(F.col(key), F.col(value))
    return df.groupBy("chat_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def personality_report(messages: DataFrame, chats: DataFrame, links: DataFrame, signals: DataFrame) -> DataFrame:
    """chat_report with hours, lengths, emoji, slang and stickers as maps. A chat has few of each."""
    out = chat_report(messages, chats, links)
    for part in (
        _map(hour_distribution(messages), "hour", "n", "hours"),
        _map(length_distribution(messages), "bucket", "n", "lengths"),
        _map(top_signals(messages, signals, "emoji_usage"), "item", "n", "emoji"),
        _map(top_signals(messages, signals, "slang_markers"), "item", "n", "slang"),
        _map(top_stickers(messages), "emoticon", "n", "stickers"),
        top_stickers(messages).groupBy("chat_id").agg(F.max("total").alias("sticker_total")),
    ):
        out = out.join(part, "chat_id", "left")
    return out.orderBy(F.col("relevance_score").desc(), "chat_id")


def chat_overview(messages: DataFrame, chats: DataFrame, links: DataFrame) -> DataFrame:
    """Per chat: share of outgoing (whole percent), peak hour and dominant length; ties to the smaller hour or name."""
    best = lambda d, c: d.groupBy("chat_id").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
    out = chat_report(messages, chats, links).join(best(hour_distribution(messages), "hour"), "chat_id", "left").join(best(length_distribution(messages), "bucket"), "chat_id", "left")
    return out.select(*_CHAT, "total", F.expr("cast(outgoing * 100 div total as int)").alias("outgoing_pct"), "episodes", F.col("hour").alias("peak_hour"), F.col("bucket").alias("dominant_length"))


def style_length_shares(messages: DataFrame) -> DataFrame:
    """Shares of the length buckets among own in-window messages with text."""
    rows = _remembered(messages).where(F.col("is_outgoing") & (F.col("text") != ""))
    counts = rows.groupBy(X.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("bucket", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def style_top_items(messages: DataFrame, signals: DataFrame, signal_type: str, n: int) -> DataFrame:
    """The n most frequent items over all chats: the first 2 n are taken, noise left out, n kept."""
    counts = _items(messages, signals, signal_type).groupBy("item").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "item").limit(2 * n)
    return top.where(~X.is_emoji_noise(F.col("item"))).orderBy(F.col("n").desc(), "item").limit(n)


def style_profile(messages: DataFrame, signals: DataFrame, gap_seconds: int = 120) -> DataFrame:
    """One row: length shares, burst statistics, 15 slang words and 10 emoji."""
    shares = style_length_shares(messages).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "share")))).alias("length_shares"))
    listed = lambda kind, n, name: style_top_items(messages, signals, kind, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "item"))).alias("l")).select(F.col("l.item").alias(name))
    # one row each
    return shares.crossJoin(burst_stats(messages, gap_seconds)).crossJoin(listed("slang_markers", 15, "slang")).crossJoin(listed("emoji_usage", 10, "emoji"))


def validation_stats(messages: DataFrame, chats: DataFrame, episodes: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: messages, episodes and signals in all."""
    m = _live(messages).agg(F.count("*").alias("messages"), F.count_if("in_memory_window").alias("in_window"), F.count_if("is_outgoing").alias("outgoing"))
    e = episodes.agg(F.count("*").alias("episodes"), F.coalesce(F.avg("message_count"), F.lit(0.0)).alias("avg_episode_size"))
    return m.crossJoin(e).crossJoin(signals.agg(F.count("*").alias("signals")))  # one row each


def chats_by_surface(chats: DataFrame) -> DataFrame:
    return chats.where(F.col("personality_surface") != "").groupBy("personality_surface").agg(F.count("*").alias("chats"))


def empty_high_score_chats(messages: DataFrame, chats: DataFrame, least: float = 0.8) -> DataFrame:
    """Chats of a high score without a live message."""
    high = _chats(chats).where(F.col("relevance_score") > F.lit(least).cast("float"))
    return high.join(_live(messages).select("chat_id"), "chat_id", "left_anti").orderBy(F.col("relevance_score").desc(), "chat_id")


def validation_warnings(messages: DataFrame, chats: DataFrame, episodes: DataFrame, signals: DataFrame) -> DataFrame:
    """(warning): the rules that the stored layers break."""
    empty = empty_high_score_chats(messages, chats).agg(F.count("*").alias("empty_chats"))
    row = validation_stats(messages, chats, episodes, signals).crossJoin(empty)  # one row each
    m, e = F.col("messages"), F.col("episodes")
    share = 100.0 * F.col("in_window") / m
    rules = {
        "few_in_window": (m > 0) & (share < 10),
        "nearly_all_in_window": (m > 0) & (share > 95),
        "no_signals": F.col("signals") == 0,
        "no_episodes": (m > 100) & (e == 0),
        "few_episodes": (m > 500) & (e > 0) & (e / m < 0.005),
        "empty_high_score_chats": F.col("empty_chats") > 0,
    }
    return row.select(F.explode(F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda w: w.isNotNull())).alias("warning"))


def chat_inspect(messages: DataFrame, chats: DataFrame, links: DataFrame) -> DataFrame:
    """Per chat, also empty ones: live messages by direction and window, and episodes."""
    own, kept = F.col("is_outgoing"), F.col("in_memory_window")
    counts = (
        _with_episode(_live(messages), links)
        .groupBy("chat_id")
        .agg(
            F.count("*").alias("total"), F.count_if(own).alias("outgoing"), F.count_if(kept).alias("in_window"), F.count_if(own & kept).alias("outgoing_in_window"), F.count_if(~own & kept).alias("incoming_in_window"), F.count_distinct("episode_id").alias("episodes")
        )
    )
    return _chats(chats).join(counts, "chat_id", "left").fillna(0, ["total", "outgoing", "in_window", "outgoing_in_window", "incoming_in_window", "episodes"])


def top_chats(messages: DataFrame, chats: DataFrame, links: DataFrame, n: int = 20) -> DataFrame:
    rows = chat_inspect(messages, chats, links).select(*_CHAT, "total", "in_window", "outgoing", "episodes")
    return rows.orderBy(F.col("total").desc(), "chat_id").limit(n)


def episode_sizes(episodes: DataFrame, chats: DataFrame) -> DataFrame:
    """Per chat: smallest, mean and largest episode; 0 without any."""
    sizes = episodes.groupBy("chat_id").agg(F.min("message_count").alias("min_size"), F.avg("message_count").alias("avg_size"), F.max("message_count").alias("max_size"))
    return chats.select(F.col("id").alias("chat_id")).join(sizes, "chat_id", "left").fillna(0)


def largest_episodes(episodes: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("chat_id").orderBy(F.col("message_count").desc(), "episode_id")
    return episodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _volumes() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("in_memory_window").alias("in_window"), F.count_if("is_outgoing").alias("outgoing")]


def media_kinds(messages: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("media_kind", F.lit("")) == "", "text").otherwise(F.col("media_kind"))
    return _live(messages).groupBy(kind.alias("kind")).agg(*_volumes())


def media_kind_totals(messages: DataFrame, kind: str) -> DataFrame:
    return _live(messages).where(F.col("media_kind") == kind).agg(*_volumes())


def media_top_chats(messages: DataFrame, chats: DataFrame, kind: str, surface: str | None = None, n: int = 5) -> DataFrame:
    own = _chats(chats) if surface is None else _chats(chats).where(F.col("personality_surface") == surface)
    counts = _live(messages).where(F.col("media_kind") == kind).groupBy("chat_id").agg(*_volumes())
    return own.join(counts, "chat_id").orderBy(F.col("total").desc(), "chat_id").limit(n)


def top_emoticons(messages: DataFrame, n: int = 10) -> DataFrame:
    rows = _live(messages).where(F.col("media_kind") == "sticker").select(_emoticon(messages).alias("emoticon")).where(F.col("emoticon") != "")
    return rows.groupBy("emoticon").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "emoticon").limit(n)


def media_by_surface(messages: DataFrame, chats: DataFrame, kind: str) -> DataFrame:
    counts = _live(messages).where(F.col("media_kind") == kind).groupBy("chat_id").agg(*_volumes())
    rows = _chats(chats).where(F.col("personality_surface") != "").join(counts, "chat_id")
    return rows.groupBy("personality_surface").agg(F.sum("total").alias("total"), F.sum("in_window").alias("in_window"))


def voice_top_chats(messages: DataFrame, chats: DataFrame, n: int = 20) -> DataFrame:
    """Chats with most voice messages; totals and surfaces are media_kind_totals and media_by_surface of `voice`."""
    return media_top_chats(messages, chats, "voice", None, n)


def bot_dialogs(log: DataFrame) -> DataFrame:
    """Per user of a bot log: last name in sorting order that is not blank, messages, time of the last; newest first."""
    rows = log.groupBy("user_id").agg(F.max(F.when(F.col("username") != "", F.col("username"))).alias("username"), F.count("*").alias("messages"), F.max("created_at").alias("last_at"))
    return rows.orderBy(F.col("last_at").desc(), "user_id")


def bot_dialog(log: DataFrame, user_id: int, n: int = 50) -> DataFrame:
    """The user's newest n messages, oldest first."""
    newest = log.where(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    return newest.orderBy("created_at", "id")


def dialog_history(log: DataFrame, n: int = 16) -> DataFrame:
    """Each chat's last n turns with turn counting from the oldest kept one."""
    w = Window.partitionBy("chat_id")
    last = log.withColumn("rep__n", F.row_number().over(w.orderBy(F.col("created_at").desc(), F.col("id").desc()))).where(F.col("rep__n") <= n)
    return last.withColumn("turn", F.row_number().over(w.orderBy(F.col("rep__n").desc()))).drop("rep__n")


def signals_by_type(signals: DataFrame, messages: DataFrame, signal_type: str, n: int = 100) -> DataFrame:
    """The newest n rows of one signal type."""
    rows = signals.where(F.col("signal_type") == signal_type).join(messages.select(F.col("id").alias("message_id"), "sent_at"), "message_id")
    return rows.orderBy(F.col("sent_at").desc(), F.col("message_id").desc()).limit(n)
