"""The ingest workload on a small log."""

from pyspark.sql import functions as F

from chatloom.plans import workloads

from .test_chat import random_messages


def test_chats_are_scored_once(spark):
    """Scored chats are a stored table, so their filter does not move into what the dialogs are made of."""
    df, rows = random_messages(spark, 31, n=80)
    df = df.withColumns({"media_kind": F.lit(""), "sticker_emoticon": F.lit(None).cast("string")})
    dialogs = df.select(F.col("chat_id").alias("id")).distinct().select("id", F.lit("private").alias("type"), F.lit(False).alias("is_bot"), F.lit(False).alias("is_creator"), F.lit(False).alias("is_admin"))
    memory, marks = workloads.sync(dialogs, df, df.where("false"), spark.createDataFrame([], "chat_id long, last_message_id long"))
    assert memory.chats.inputFiles() and memory.chats.count() == dialogs.count()
    assert memory.messages.count() == len(rows) and memory.semantic.count() == len(rows) and marks.count() == dialogs.count()
