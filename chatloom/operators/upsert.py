"""Idempotent merging of new rows into stored tables, cursors and deletion marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def latest(batch: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """One row for each key: the last to arrive (by the arrival column, else the largest row)."""
    rest = [c for c in batch.columns if c not in keys]
    packed = F.struct(*rest)
    by = F.col(arrival) if arrival else F.to_json(packed)
    return batch.groupBy(*keys).agg(F.max_by(packed, by).alias("up__row")).select(*keys, "up__row.*").select(*batch.columns)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], update: list[str], arrival: str | None = None) -> DataFrame:
    """Insert or update by key: update columns take the new value, others keep the first."""
    batch = latest(new, keys, arrival)
    n = batch.select(*[F.col(c).alias(f"up__{c}") for c in batch.columns], F.lit(True).alias("up__new"))
    b = base.withColumn("up__old", F.lit(True))
    both = b.join(n, reduce(lambda x, y: x & y, [b[k].eqNullSafe(n[f"up__{k}"]) for k in keys]), "full")
    is_new, is_old = F.col("up__new").isNotNull(), F.col("up__old").isNotNull()
    cols = []
    for c in base.columns:
        fresh = F.col(f"up__{c}") if c in new.columns else F.lit(None).cast(base.schema[c].dataType)
        take = is_new if c in update and c in new.columns else ~is_old
        cols.append(F.when(take, fresh).otherwise(b[c]).alias(c))
    return both.select(*cols)


#: Columns that a re-read message, chat or user brings up to date.
MESSAGE_UPDATES = ["text", "raw_data", "entities", "reactions", "sticker_meta", "media_kind", "is_forwarded", "forward_from_id", "forward_date", "edit_date", "synced_at"]


def upsert_semantic(base: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of normalised texts; a transcript that is stored stays."""
    done = base.where(F.col("transcribed_at").isNotNull())
    return upsert(base, new.join(done, "message_id", "left_anti"), ["message_id"], ["normalized_text", "language", "token_count", "skip_embedding"])


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of new whose key it lacks (one row for each key)."""
    fresh = new.dropDuplicates(keys)
    return base.unionByName(fresh.join(base, _on(fresh, base, keys), "left_anti"), allowMissingColumns=True)


def ensure_users(users: DataFrame, participants: DataFrame, messages: DataFrame) -> DataFrame:
    """Participants upserted, and stub rows for senders that only occur in messages (0 and null skipped)."""
    update = [c for c in participants.columns if c not in ("id", "created_at")]
    known = upsert(users, participants, ["id"], update)
    senders = messages.where(F.coalesce("sender_id", F.lit(0)) != 0).select(F.col("sender_id").alias("id")).distinct()
    return insert_if_absent(known, senders, ["id"])


def new_since_cursor(messages: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages beyond their chat's cursor, cursors after them). A chat without a cursor starts at 0."""
    marks = cursors.groupBy("chat_id").agg(F.max("last_message_id").alias("cur__last"))
    new = messages.join(marks, "chat_id", "left").where(F.col("telegram_id") > F.coalesce("cur__last", F.lit(0))).drop("cur__last")
    reached = new.groupBy("chat_id").agg(F.max("telegram_id").alias("last_message_id"))
    both = marks.withColumnRenamed("cur__last", "last_message_id").union(reached.select("chat_id", "last_message_id"))
    return new.select(*messages.columns), both.groupBy("chat_id").agg(F.max("last_message_id").alias("last_message_id"))


def mark_deleted(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """is_deleted set for the given (telegram_id, chat_id)."""
    gone = keys.select("telegram_id", "chat_id").distinct().withColumn("del__hit", F.lit(True))
    hit = F.coalesce(F.col("del__hit"), F.lit(False))
    return messages.join(gone, ["telegram_id", "chat_id"], "left").withColumn("is_deleted", hit | F.coalesce("is_deleted", F.lit(False))).select(*messages.columns)
