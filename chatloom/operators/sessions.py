"""Turns: consecutive messages of one author without a long pause, and their statistics.

Utterances are built per chat, also when many chats are taken at once. A turn's key is the id of
its first message.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import ORDER, SPAN, bucketed, with_previous, with_row_number

GAP_SECONDS = 120


def utterance_input(messages: DataFrame, semantic: DataFrame, chats: DataFrame) -> DataFrame:
    """Live in-window messages with normalised text and chat title; nulls become '' and 0."""
    live = messages.where(F.col("in_memory_window") & ~F.col("is_deleted"))
    s = semantic.select(F.col("message_id").alias("id"), "normalized_text", "token_count")
    c = chats.select(F.col("id").alias("chat_id"), F.col("title").alias("chat_title"))
    rows = live.join(s, "id", "left").join(c, "chat_id", "left")
    return rows.select(
        "id",
        "telegram_id",
        "chat_id",
        F.coalesce("chat_title", F.lit("")).alias("chat_title"),
        F.coalesce("sender_id", F.lit(0)).cast("long").alias("author_id"),
        "sent_at",
        F.coalesce("normalized_text", F.lit("")).alias("normalized_text"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        "is_outgoing",
        F.coalesce("media_kind", F.lit("")).alias("media_kind"),
    )


def _runs(rows: DataFrame, gap: Column, keys: list[str], aggs: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Runs of one author without a pause above gap: keys, run_id (id of the first message), started_at, ended_at and aggs.

    Each of aggs is (what to compute over rows, how to put parts together). Rows meet by key and
    day and are put together there; then only the parts at a day's ends, two a day at most,
    meet by key, so neither a window nor a join ever sees a whole chat's rows.
    """
    span = bucketed(rows)
    within = Window.partitionBy(*keys, SPAN).orderBy(*ORDER)
    span = span.withColumns({"ses__before": F.lag(F.struct("author_id", F.unix_micros("sent_at").alias("at"))).over(within), "ses__end": F.lead("id").over(within).isNull()})
    new = F.coalesce(_breaks(F.col("ses__before"), gap), F.lit(False))
    span = span.withColumn("ses__no", F.sum(new.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = span.groupBy(*keys, SPAN, "ses__no").agg(
        F.min(F.struct(*ORDER)).alias("ses__first"),
        F.max("sent_at").alias("ended_at"),
        F.max("author_id").alias("author_id"),
        F.max("ses__end").alias("ses__end"),
        *[made.alias(n) for n, (made, _) in aggs.items()],
    )
    # a part inside its day stands alone; the others are compared with the part before, if they begin a day
    parts = parts.withColumns({"ses__alone": F.when((F.col("ses__no") > 1) & ~F.col("ses__end"), F.struct(SPAN, "ses__no")), "sent_at": F.col("ses__first.sent_at")})
    across = Window.partitionBy(*keys, "ses__alone").orderBy("ses__first")
    before = F.lag(F.struct("author_id", F.unix_micros("ended_at").alias("at"))).over(across)
    parts = parts.withColumn("ses__before", before)
    new = (F.col("ses__no") > 1) | F.coalesce(_breaks(F.col("ses__before"), gap), F.lit(False))
    parts = parts.withColumn("ses__run", F.sum(new.cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy(*keys, "ses__alone", "ses__run").agg(F.min("ses__first").alias("ses__first"), F.max("ended_at").alias("ended_at"), F.max("author_id").alias("author_id"), *[merge(n).alias(n) for n, (_, merge) in aggs.items()])
    return runs.select(*keys, F.col("ses__first.id").alias("run_id"), "author_id", F.col("ses__first.sent_at").alias("started_at"), "ended_at", *aggs)


def _breaks(before: Column, gap: Column) -> Column:
    return before.isNull() | (before["author_id"] != F.col("author_id")) | (F.unix_micros("sent_at") - before["at"] > gap * 1_000_000)


def _says() -> Column:
    return (F.col("token_count") > 0) & ~X.is_blank(F.col("normalized_text"))


def build_utterances(rows: DataFrame, gap_seconds: int = GAP_SECONDS, *, positions: bool = True) -> DataFrame:
    """Turns of utterance_input rows: a new author or a pause longer than the gap begins one.

    Text is the blank-joined texts of the messages that have tokens; turns without any are dropped.
    position counts the chat's kept turns from 0; it takes a second pass, which positions=False
    saves. One turn's messages meet in one task.
    """
    order = F.struct(*ORDER)
    turns = _runs(
        rows,
        F.lit(gap_seconds),
        ["chat_id"],
        {
            "chat_title": (F.max("chat_title"), F.max),
            "is_outgoing": (F.min(F.struct(order.alias("o"), "is_outgoing")), F.min),
            "message_count": (F.count("*"), F.sum),
            "said": (F.collect_list(F.when(_says(), F.struct(order.alias("o"), F.col("normalized_text").alias("t")))), lambda n: F.flatten(F.collect_list(n))),
            "voice_count": (F.count_if(F.col("media_kind") == "voice"), F.sum),
        },
    )
    turns = turns.where(F.size("said") > 0).select(
        "chat_id",
        F.col("run_id").alias("first_message_id"),
        "chat_title",
        "author_id",
        F.col("is_outgoing.is_outgoing").alias("is_outgoing"),
        "started_at",
        "ended_at",
        "message_count",
        F.array_join(F.array_sort("said")["t"], " ").alias("text"),
        (F.col("voice_count") > 0).alias("has_voice"),
        "voice_count",
    )
    if not positions:
        return turns
    return with_row_number(turns, "position", order=("started_at", "first_message_id")).withColumn("position", F.col("position") - 1)


def burst_stats(messages: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row over all chats: avg_size and p90_size of outgoing bursts, p50_gap and p90_gap (seconds) within them.

    Incoming messages break a burst. Only in-window live messages count; without inner gaps they are 0.
    """
    live = messages.where(~F.col("is_deleted") & F.col("in_memory_window")).select("chat_id", *ORDER, "is_outgoing")
    sides = live.withColumn("author_id", F.col("is_outgoing").cast("int"))
    bursts = _runs(sides, F.lit(gap_seconds), ["chat_id"], {"n": (F.count("*"), F.sum)}).where("author_id = 1")
    sizes = bursts.agg(F.avg("n").alias("avg_size")).crossJoin(percentiles(bursts, "n", {"p90_size": 0.9}))
    seen = with_previous(live, {"ses__out": F.col("is_outgoing"), "ses__at": F.unix_micros("sent_at")})
    gap = (F.unix_micros("sent_at") - F.col("ses__at")) / 1_000_000
    inner = seen.where(F.col("is_outgoing") & F.col("ses__out") & (gap <= gap_seconds) & (gap >= 0)).select(gap.alias("gap"))
    gaps = percentiles(inner, "gap", {"p50_gap": 0.5, "p90_gap": 0.9})
    return sizes.crossJoin(gaps.select(*[F.coalesce(n, F.lit(0.0)).alias(n) for n in gaps.columns]))  # one row each


def compare_gaps(rows: DataFrame, gaps: Sequence[int] = (30, 60, 120, 300)) -> DataFrame:
    """For each gap: utterances, mean messages, share of turns of several messages (percent)."""
    narrow = rows.select("chat_id", *ORDER, "author_id", _says().alias("says"))
    each = narrow.withColumn("gap_seconds", F.explode(F.array(*[F.lit(g) for g in gaps])))
    aggs = {"message_count": (F.count("*"), F.sum), "said": (F.count_if("says"), F.sum)}
    turns = _runs(each, F.col("gap_seconds"), ["gap_seconds", "chat_id"], aggs).where("said > 0")
    return turns.groupBy("gap_seconds").agg(
        F.count("*").alias("utterances"), F.avg("message_count").alias("mean_messages"), (100.0 * F.count_if(F.col("message_count") > 1) / F.count("*")).alias("multi_pct")
    )


def top_bursts(utterances: DataFrame, n: int = 50) -> DataFrame:
    """The n turns with most messages (two at least), with their duration."""
    rows = utterances.where(F.col("message_count") > 1)
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000
    return rows.orderBy(F.col("message_count").desc(), "first_message_id").limit(n).select("first_message_id", "chat_id", "message_count", seconds.alias("duration_secs"), "text")


def _at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: for each name the sorted values' item at a rank (0-based, from the number of rows), and `total`.

    Equal values are counted first and the counts summed in at most 4,160 bins of like size, in the
    order of the values (which must not be negative); a value is ranked within its bin alone.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("pct__v")).agg(F.count("*").alias("pct__n"))
    counts = counts.withColumn("pct__bin", F.floor(F.log2(F.col("pct__v") + 1) * 64))
    bins = counts.groupBy("pct__bin").agg(F.sum("pct__n").alias("pct__m"))
    upto = Window.orderBy("pct__bin").rowsBetween(Window.unboundedPreceding, 0)  # bins, not rows
    bins = bins.select("pct__bin", (F.sum("pct__m").over(upto) - F.col("pct__m")).alias("pct__low"), F.sum("pct__m").over(Window.partitionBy()).alias("pct__total"))
    within = Window.partitionBy("pct__bin").orderBy("pct__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("pct__upto", F.sum("pct__n").over(within)).join(F.broadcast(bins), "pct__bin")
    high = F.col("pct__low") + F.col("pct__upto")
    holds = lambda rank: (rank >= high - F.col("pct__n")) & (rank < high)
    return placed.agg(F.max("pct__total").alias("total"), *[F.max(F.when(holds(r(F.col("pct__total"))), F.col("pct__v"))).alias(n) for n, r in ranks.items()])


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact percentiles, interpolated between neighbours; null without rows."""
    place = lambda p, n: p * (n - 1)
    ranks = {f"{name}{end}": (lambda n, p=p, f=f: f(place(p, n))) for name, p in shares.items() for end, f in (("__low", F.floor), ("__high", F.ceil))}
    rows = _at_ranks(df, value, ranks)
    at = {name: (place(p, F.col("total")), F.col(f"{name}__low"), F.col(f"{name}__high")) for name, p in shares.items()}
    return rows.select(*[F.when(F.floor(k) == F.ceil(k), low.cast("double")).otherwise((F.ceil(k) - k) * low + (k - F.floor(k)) * high).alias(n) for n, (k, low, high) in at.items()])


def ranked_percentiles(df: DataFrame, value: str, percents: Sequence[int]) -> DataFrame:
    """One row: the sorted values' item at n * p div 100 (0-based) for each percent."""
    rows = _at_ranks(df, value, {f"p{p}": (lambda n, p=p: F.floor(n * p / 100)) for p in percents})
    return rows.drop("total")


def utterance_stats(utterances: DataFrame) -> DataFrame:
    """One row: size statistics, size buckets and voice counts of the turns."""
    n = F.col("message_count")
    some, whole = F.col("has_voice"), F.col("voice_count") == n
    sums = utterances.agg(
        F.count("*").alias("utterances"),
        F.avg(n).alias("mean"),
        F.max(n).alias("max"),
        F.count_if(n == 1).alias("n_1"),
        F.count_if(n == 2).alias("n_2"),
        F.count_if((n >= 3) & (n <= 5)).alias("n_3_5"),
        F.count_if((n >= 6) & (n <= 10)).alias("n_6_10"),
        F.count_if(n > 10).alias("n_over_10"),
        F.count_if(some).alias("has_voice"),
        F.count_if(some & whole).alias("voice_only"),
        F.count_if(some & ~whole).alias("voice_mixed"),
        F.count_if(some & (n > 1)).alias("voice_in_burst"),
    )
    marks = ranked_percentiles(utterances, "message_count", (50, 90)).toDF("median", "p90")
    return sums.crossJoin(marks)  # one row each


def token_length_audit(utterances: DataFrame) -> DataFrame:
    """One row: percentiles, buckets and tail shares (percent) of the turns' approximate token counts."""
    rows = utterances.select(X.approx_tokens(F.col("text"), 1).alias("t"))
    t = F.col("t")
    edges = [0, 64, 128, 256, 512, 1024]
    buckets = [F.count_if((t >= a) & (t < b)).alias(f"under_{b}") for a, b in zip(edges, edges[1:], strict=False)]
    tails = [(100.0 * F.count_if(t >= b) / F.count("*")).alias(f"from_{b}_pct") for b in (256, 512, 1024)]
    sums = rows.agg(F.max("t").alias("max"), *buckets, F.count_if(t >= 1024).alias("from_1024"), *tails)
    return ranked_percentiles(rows, "t", (50, 75, 90, 95, 99)).crossJoin(sums)  # one row each


def longest_utterances(utterances: DataFrame, n: int = 10) -> DataFrame:
    rows = utterances.withColumn("tokens", X.approx_tokens(F.col("text"), 1))
    return rows.orderBy(F.col("tokens").desc(), "first_message_id").limit(n).select("first_message_id", "tokens", "message_count", "is_outgoing", X.preview(F.col("text"), 60).alias("preview"))


def utterance_summary(utterances: DataFrame) -> DataFrame:
    """One row: outgoing, incoming, multi-message turns and their percent, mean messages."""
    multi = F.count_if(F.col("message_count") > 1)
    return utterances.agg(
        F.count_if("is_outgoing").alias("outgoing"), F.count_if(~F.col("is_outgoing")).alias("incoming"), multi.alias("multi"), (100.0 * multi / F.count("*")).alias("multi_pct"), F.avg("message_count").alias("mean_messages")
    )
