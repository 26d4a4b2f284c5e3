"""Gapless numbers within keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are ordered in one group.
PART = 1 << 16


def numbered(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str, weight: str | None = None) -> DataFrame:
    """df with a long column out: 0, 1, 2 ... within equal keys (which are not null).

    A row is dealt by a hash of its order columns into one of rows / PART parts of its key, rows
    being the number of rows of df; it is ordered within its part, and what lies before a part
    comes from the parts' counts. So no key's rows meet in one task, and the numbers depend on
    the rows alone. With a weight column a row takes that many numbers, of which out is the first.
    Rows with equal order columns come in any order.
    """
    n = F.col(weight) if weight else F.lit(1)
    parts = -(-max(rows, 1) // PART)
    dealt = df.withColumn("num__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = dealt.groupBy(*keys, "num__part").agg(F.sum(n).alias("num__n"))

    def before(by: list[str], *cols: str):
        return Window.partitionBy(*by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)

    offsets = sizes.select(*keys, "num__part", F.coalesce(F.sum("num__n").over(before(keys, "num__part")), F.lit(0)).alias("num__before"))
    within = dealt.withColumn("num__at", F.coalesce(F.sum(n).over(before([*keys, "num__part"], *order)), F.lit(0)))
    return within.join(offsets, [*keys, "num__part"]).select(*df.columns, (F.col("num__before") + F.col("num__at")).cast("long").alias(out))
