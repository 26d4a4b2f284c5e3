"""Message records: schemas, reading, mapping of raw peers and media, writing of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = (
    "id long, telegram_id long, chat_id long, sender_id long, reply_to_id long, text string, raw_data string, "
    "entities array<struct<Type:string,Offset:int,Length:int,URL:string>>, reactions array<struct<Emoji:string,Count:int>>, "
    "sticker_meta struct<SetName:string,Emoticon:string>, media_kind string, sent_at timestamp, synced_at timestamp, "
    "is_outgoing boolean, is_deleted boolean, is_forwarded boolean, forward_from_id long, forward_date timestamp, "
    "edit_date timestamp, in_memory_window boolean"
)

#: Raw JSON records: one object a line, times in Unix seconds, absent numbers as 0.
RAW = (
    "telegram_id long, chat_id long, sender_id long, reply_to_id long, text string, sent_at long, is_outgoing boolean, "
    "entities array<struct<Type:string,Offset:int,Length:int,URL:string>>, reactions array<struct<Emoji:string,Count:int>>, "
    "sticker_meta struct<SetName:string,Emoticon:string>, media_kind string, is_forwarded boolean, forward_from_id long, "
    "forward_date long, edit_date long, _corrupt_record string"
)


def message_key() -> Column:
    """A stable surrogate id of (chat_id, telegram_id)."""
    return F.xxhash64("chat_id", "telegram_id")


def from_raw(raw: DataFrame) -> DataFrame:
    """Raw records as messages: zeros become null, blank reactions go, flags get their defaults."""
    some = lambda c: F.nullif(F.col(c), F.lit(0).cast("long"))
    when = lambda c: F.timestamp_seconds(some(c))
    no = F.lit(False)
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("telegram_id").isNotNull() & F.col("chat_id").isNotNull())
    return good.select(
        message_key().alias("id"),
        "telegram_id",
        "chat_id",
        some("sender_id").alias("sender_id"),
        some("reply_to_id").alias("reply_to_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.to_json(F.struct("telegram_id", "chat_id", "sender_id", "text", "sent_at", "media_kind")).alias("raw_data"),
        "entities",
        F.filter("reactions", lambda r: F.trim(F.coalesce(r["Emoji"], F.lit(""))) != "").alias("reactions"),
        "sticker_meta",
        F.coalesce("media_kind", F.lit("")).alias("media_kind"),
        when("sent_at").alias("sent_at"),
        F.lit(None).cast("timestamp").alias("synced_at"),
        F.coalesce("is_outgoing", no).alias("is_outgoing"),
        no.alias("is_deleted"),
        F.coalesce("is_forwarded", no).alias("is_forwarded"),
        some("forward_from_id").alias("forward_from_id"),
        when("forward_date").alias("forward_date"),
        when("edit_date").alias("edit_date"),
        F.lit(True).alias("in_memory_window"),
    )


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Messages from JSON lines of RAW records, or from Parquet in the MESSAGES schema. Broken lines are left out."""
    if fmt == "json":
        raw = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        return from_raw(raw)
    return spark.read.schema(MESSAGES).format(fmt).load(path)


def broken_records(spark: SparkSession, path: str) -> DataFrame:
    """The lines that read_messages leaves out."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", RAW, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where(F.col("r._corrupt_record").isNotNull() | F.col("r.telegram_id").isNull() | F.col("r.chat_id").isNull()).select("line")


def resolve_sender(from_user: Column, peer_kind: Column, chat_id: Column, outgoing: Column, self_id: Column) -> Column:
    """The sending user; in one-to-one chats without one, self or the partner; else null."""
    return F.coalesce(from_user, F.when(peer_kind == "user", F.when(outgoing, self_id).otherwise(chat_id)))


def classify_media(media: Column, attributes: Column) -> Column:
    """Kind of a raw media (its class name, '' for none) with document attributes (kind, voice, round).

    The first attribute that decides wins: sticker, voice audio, round or plain video.
    """
    decides = F.filter(attributes, lambda a: a["kind"].isin("sticker", "video") | ((a["kind"] == "audio") & F.coalesce(a["voice"], F.lit(False))))
    first = F.get(decides, F.lit(0))
    document = F.when(first["kind"] == "sticker", "sticker").when(first["kind"] == "audio", "voice").when(first["kind"] == "video", F.when(F.coalesce(first["round"], F.lit(False)), "round").otherwise("video"))
    return (
        F.when(F.coalesce(media, F.lit("")) == "", "")
        .when(media == "document", F.coalesce(document, F.lit("document")))
        .when(media.isin("geo", "geo_live"), "geo")
        .when(media.isin("photo", "contact", "poll"), media)
        .otherwise("document")
    )


def classify_dialog(peers: DataFrame) -> DataFrame:
    """Dialogs (id, type, title, username, is_bot, is_creator, is_admin) from raw peers.

    peers: peer_kind user/chat/channel, id, is_self, first_name, last_name, title, username, bot,
    creator, admin_rights, megagroup. Other kinds of peers are left out.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    user, own = F.col("peer_kind") == "user", flag("is_self")
    name = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "first_name", "last_name")), F.lit("")), F.col("username"))
    return peers.where(F.col("peer_kind").isin("user", "chat", "channel")).select(
        "id",
        F.when(user & own, "saved_messages").when(user, "private").when(F.col("peer_kind") == "chat", "group").when(flag("megagroup"), "supergroup").otherwise("channel").alias("type"),
        F.when(user & own, "Saved Messages").when(user, name).otherwise(F.col("title")).alias("title"),
        F.when(user & own | (F.col("peer_kind") == "chat"), None).otherwise(F.col("username")).alias("username"),
        (user & ~own & flag("bot")).alias("is_bot"),
        (~user & flag("creator")).alias("is_creator"),
        (~user & flag("admin_rights")).alias("is_admin"),
    )


def write_layer(df: DataFrame, path: str, buckets: int = 64, key: str = "chat_id") -> None:
    """Write a layer as Parquet, partitioned by a hash bucket of the chat; only the buckets in df are replaced.

    Rows of a bucket are spread over several files when AQE finds them large.
    """
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
