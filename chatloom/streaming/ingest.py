"""Incremental ingest with Structured Streaming: the checkpoint is the cursor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from ..operators.layers import build_semantic, extract_signals
from ..operators.upsert import latest, upsert
from ..sources.store import LayerStore


def stream_messages(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as they arrive; a restarted query goes on where its checkpoint is."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_dedup(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One row of each (chat_id, telegram_id) under repeated delivery within the lateness."""
    return messages.withWatermark("sent_at", lateness).dropDuplicatesWithinWatermark(["chat_id", "telegram_id"])


def semantic_stream(messages: DataFrame) -> DataFrame:
    return build_semantic(messages)


def signal_stream(messages: DataFrame) -> DataFrame:
    return extract_signals(messages)


#: Keys of the layers, and what an update leaves as it is.
KEYS = {"messages": ["chat_id", "telegram_id"], "semantic": ["message_id"], "signals": ["message_id", "signal_type"]}
KEEP = {"messages": {"sender_id", "reply_to_id", "sent_at", "in_memory_window"}, "semantic": set(), "signals": set()}


def batch_layers(batch: DataFrame) -> dict[str, DataFrame]:
    """A batch's messages, each once, and the layers made of them."""
    once = latest(batch, KEYS["messages"])
    return {"messages": once, "semantic": build_semantic(once), "signals": extract_signals(once)}


def store_layers(messages: DataFrame, path: str) -> dict[str, LayerStore]:
    """Stores below path for the layers of a stream of messages."""
    spread = {"messages": "chat_id", "semantic": "message_id", "signals": "message_id"}
    columns = {"messages": messages.columns, "semantic": build_semantic(messages).columns, "signals": extract_signals(messages).columns}
    return {n: LayerStore(messages.sparkSession, f"{path}/{n}", KEYS[n], [c for c in columns[n] if c not in KEYS[n] and c not in KEEP[n]], spread[n]) for n in KEYS}


def layers_sink(stores: dict[str, LayerStore]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch's messages, each once, and the layers made of them into store_layers.

    The layers are made of the rows that the messages' store has written, so that a batch is shuffled once.
    """

    def run(batch: DataFrame, number: int) -> None:
        stores["messages"].merge(latest(batch.repartition(*KEYS["messages"]), KEYS["messages"]), number)
        once = stores["messages"].batch(number, batch)
        for name, make in (("semantic", build_semantic), ("signals", extract_signals)):
            stores[name].merge(make(once), number)

    return run


def layer_sink(base_path: str, read: Callable[[SparkSession, str, int], DataFrame | None], write: Callable[[DataFrame, str, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts a batch of messages and its layers.

    read(spark, layer, batch) gives the layer as it was before the batch, or None; write(df, layer,
    batch) must be idempotent for a batch number, as a batch may be run again.
    """
    def run(batch: DataFrame, number: int) -> None:
        for name, df in batch_layers(batch).items():
            old = read(batch.sparkSession, f"{base_path}/{name}", number)
            update = [c for c in df.columns if c not in KEYS[name] and c not in KEEP[name]]
            write(df if old is None else upsert(old, df, KEYS[name], update), f"{base_path}/{name}", number)

    return run


_TURN = "chat_id long, first_message_id long, author_id long, is_outgoing boolean, started_us long, ended_us long, message_count int, text string, voice_count int"
_OPEN = "author_id long, first_id long, outgoing boolean, started long, ended long, n int, voices int"
#: Rows (us, telegram_id, id, author_id, is_outgoing, text, kind) in packs of so many rows or characters: each value of the state costs a call.
_WAITING, _PACK_ROWS, _PACK_CHARS = "rows binary", 1 << 10, 1 << 20
_Turn = Row("chat_id", "first_message_id", "author_id", "is_outgoing", "started_us", "ended_us", "message_count", "text", "voice_count")
#: Keyed state with timers needs this state store.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packs(rows: Iterable[tuple]) -> Iterator[tuple[bytes]]:
    """Values of the waiting state."""
    pack, chars = [], 0
    for r in rows:
        pack.append(r)
        chars += len(r[5] or "")
        if len(pack) >= _PACK_ROWS or chars >= _PACK_CHARS:
            yield (pickle.dumps(pack),)
            pack, chars = [], 0
    if pack:
        yield (pickle.dumps(pack),)


class Turns(StatefulProcessor):
    """Turns of one chat: the open turn's numbers, its texts, and the rows that the watermark has not passed.

    Texts and packs of rows are appended as they come; rows are rewritten only when a timer finds some of them ready. A turn
    that opens and closes within one timer does not touch the state.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.texts = handle.getListState("texts", "text string")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None

        def new() -> Iterator[tuple]:
            nonlocal first
            for r in rows:
                us, text = r.sent_us, r.normalized_text
                first = us if first is None else min(first, us)
                yield us, r.telegram_id, r.id, r.author_id, r.is_outgoing, text if r.token_count > 0 and text.strip() else None, r.media_kind

        for pack in _packs(new()):
            self.waiting.appendValue(pack)
        self.handle.registerTimer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [w for pack in self.waiting.get() for w in pickle.loads(pack[0])] if self.waiting.exists() else []  # noqa: S301
        ready, rest = sorted((w for w in rows if w[0] < mark), key=lambda w: w[:3]), [w for w in rows if w[0] >= mark]
        turn = self.open.get() if self.open.exists() else None
        said: list[tuple[str]] = []  # texts of the open turn that are not stored yet
        kept = bool(turn)  # whether the state can hold texts of the open turn
        for us, _, first, author, outgoing, text, kind in ready:
            if turn and (turn[0] != author or us - turn[4] > self.gap):
                yield from self._close(key[0], turn, said, kept)
                turn, said, kept = None, [], False
            _, first, _, started, _, n, voices = turn or (None, first, None, us, None, 0, 0)
            turn = (author, first, turn[2] if turn else outgoing, started, us, n + 1, voices + (kind == "voice"))
            said += [(text,)] if text else []
        if turn and mark > turn[4] + self.gap and not any(w[0] <= turn[4] + self.gap for w in rest):
            yield from self._close(key[0], turn, said, kept)
            turn, said = None, []
        if ready:
            self.waiting.put([*_packs(rest)]) if rest else self.waiting.clear()
        if turn:
            self.open.update(tuple(turn))
            if said:
                self.texts.appendList(said)
        else:
            self.open.clear()
        due = [min(w[0] for w in rest)] if rest else []
        if due or turn:
            self.handle.registerTimer(min(due + ([turn[4] + self.gap] if turn else [])) // 1000)

    def _close(self, chat: int, turn: tuple, said: list[tuple[str]], kept: bool) -> Iterator[Row]:
        texts = [t[0] for t in self.texts.get()] if kept and self.texts.exists() else []
        texts += [t[0] for t in said]
        if kept:
            self.texts.clear()
        author, first, outgoing, started, ended, n, voices = turn
        if texts:
            yield _Turn(chat, first, author, outgoing, started, ended, n, " ".join(texts), voices)


def stream_utterances(messages: DataFrame, gap_seconds: int = 120, lateness: str = "10 minutes") -> DataFrame:
    """Turns of utterance_input rows as messages arrive, equal to the batch result for rows within the lateness.

    Rows wait in the state until the watermark has passed them, then join the open turn in order
    of (sent_at, telegram_id); a turn is given out when an author change or a pause longer than
    the gap closes it. State for each chat: one open turn and the rows newer than the watermark. The session's
    streams use the RocksDB state store from then on, which keyed state needs.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    rows = messages.withWatermark("sent_at", lateness).withColumn("sent_us", F.unix_micros("sent_at"))
    return rows.groupBy("chat_id").transformWithState(Turns(gap_seconds * 1_000_000), _TURN, "append", "eventTime")


def stream_burst_counts(messages: DataFrame, gap: str = "120 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Per author sessions between silent gaps: a cheap stand-in for bursts that ignores who else writes."""
    rows = messages.withWatermark("sent_at", lateness).groupBy("chat_id", "sender_id", F.session_window("sent_at", gap)).agg(F.count("*").alias("n"))
    return rows.select("chat_id", "sender_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n")
