"""Row order within long groups, without one task for a whole group.

A chat may hold a large share of all messages, so windows never span a chat. Rows are windowed
within (key, time bucket); what must cross a bucket's edge (the row before it, the number of rows
before it, the last value seen) is taken from one summary row for each bucket. A chat has as
many summary rows as it has days with messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Everywhere the order of messages in a chat.
ORDER = ("sent_at", "telegram_id", "id")
SPAN = "ord__bucket"


def _order(names: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def bucketed(df: DataFrame, time_col: str = "sent_at", span_us: int = DAY_US) -> DataFrame:
    return df.withColumn(SPAN, F.floor(F.unix_micros(time_col) / F.lit(span_us)))


def _before(summary: DataFrame, key: str) -> Window:
    return Window.partitionBy(key).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, values: dict[str, Column], key: str = "chat_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add each value as of the row before in the key's order (null for the first)."""
    rows = bucketed(df, order[0])
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    ends = rows.groupBy(key, SPAN).agg(F.max_by(packed, _order(order)).alias("ord__end"))
    ends = ends.select(key, SPAN, F.lag("ord__end").over(Window.partitionBy(key).orderBy(SPAN)).alias("ord__end"))
    within = Window.partitionBy(key, SPAN).orderBy(*order)
    rows = rows.withColumns({"ord__lag": F.lag(packed).over(within), "ord__n": F.row_number().over(within)}).join(ends, [key, SPAN])
    prev = F.when(F.col("ord__n") == 1, F.col("ord__end")).otherwise(F.col("ord__lag"))
    return rows.withColumns({n: prev[n] for n in values}).drop("ord__lag", "ord__n", "ord__end", SPAN)


def with_row_number(df: DataFrame, out: str, key: str = "chat_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add the 1-based row number in the key's order."""
    rows = bucketed(df, order[0])
    counts = rows.groupBy(key, SPAN).agg(F.count("*").alias("ord__n"))
    counts = counts.select(key, SPAN, F.coalesce(F.sum("ord__n").over(_before(counts, key)), F.lit(0)).alias("ord__n"))
    within = Window.partitionBy(key, SPAN).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(within)).join(counts, [key, SPAN]).withColumn(out, F.col(out) + F.col("ord__n")).drop("ord__n", SPAN)


def with_last_seen(df: DataFrame, value: Column, out: str, key: str = "chat_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add the last non-null value at or before each row."""
    rows = bucketed(df, order[0]).withColumn(out, value)
    ends = rows.groupBy(key, SPAN).agg(F.max_by(out, F.when(F.col(out).isNotNull(), _order(order))).alias("ord__end"))
    ends = ends.select(key, SPAN, F.last("ord__end", True).over(_before(ends, key)).alias("ord__end"))
    within = Window.partitionBy(key, SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(out, True).over(within)).join(ends, [key, SPAN]).withColumn(out, F.coalesce(out, "ord__end")).drop("ord__end", SPAN)


def near_flag(df: DataFrame, flag: Column, before: int, after: int, out: str, number: str, key: str = "chat_id", block: int = 100_000) -> DataFrame:
    """Whether a flagged row lies up to `before` rows after or `after` rows before each row.

    number is the row number in the key. Rows are windowed in blocks of `block` numbers with a
    margin of copied rows, so the frame never needs a whole key.
    """
    margin = max(before, after)
    own = F.floor((F.col(number) - 1) / block)
    low, high = F.floor((F.col(number) - 1 - margin) / block), F.floor((F.col(number) - 1 + margin) / block)
    rows = df.withColumn("ord__flag", flag).withColumn("ord__block", F.explode(F.array_distinct(F.array(own, low, high))))
    w = Window.partitionBy(key, "ord__block").orderBy(number).rowsBetween(-after, before)
    return rows.withColumn(out, F.max("ord__flag").over(w)).where(F.col("ord__block") == own).drop("ord__flag", "ord__block")
