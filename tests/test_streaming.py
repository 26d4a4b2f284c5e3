"""Streams over several micro-batches against the batch results."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from chatloom.operators import layers, sessions
from chatloom.operators.upsert import MESSAGE_UPDATES
from chatloom.streaming import ingest

from .test_chat import INPUT, START, random_messages


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def files(df, folder, order, parts=3):
    """Rows in files that arrive one after the other."""
    rows = df.orderBy(order).collect()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_dedup_and_layers(spark, tmp_path):
    df, rows = random_messages(spark, 21, n=60)
    path = files(df.union(df.where("id % 3 = 0")).withColumn("media_kind", F.lit("")), tmp_path / "in", "sent_at")
    schema = df.withColumn("media_kind", F.lit("")).schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = ingest.stream_messages(spark, path, df.withColumn("media_kind", F.lit("")).schema, files_per_batch=1)
    assert schema
    once = run(ingest.stream_dedup(stream, "400 hours"), tmp_path, "once")
    assert sorted(r.id for r in once.collect()) == sorted(r[0] for r in rows)
    said = run(ingest.semantic_stream(stream.dropDuplicates(["id"])), tmp_path, "said")
    assert sorted(map(tuple, said.collect())) == sorted(map(tuple, layers.build_semantic(df.withColumn("media_kind", F.lit(""))).collect()))


def test_layer_sink(spark, tmp_path):
    df, rows = random_messages(spark, 22, n=40)
    df = df.withColumn("media_kind", F.lit(""))
    store = {}

    def read(_, layer, number):
        return next((store[layer, k] for k in range(number - 1, -1, -1) if (layer, k) in store), None)

    def write(out, layer, number):
        store[layer, number] = spark.createDataFrame(out.collect(), out.schema)

    sink = ingest.layer_sink("s", read, write)
    for number, part in enumerate((df.where("id <= 25"), df.where("id > 15"))):
        sink(part, number)
        sink(part, number)  # a batch that runs again changes nothing
    assert sorted(r.id for r in store["s/messages", 1].collect()) == sorted(r[0] for r in rows)
    assert store["s/semantic", 1].count() == 40
    assert "text" in MESSAGE_UPDATES


def test_utterances(spark, tmp_path):
    df, _ = random_messages(spark, 23, n=150)
    rows = df.select("id", "telegram_id", "chat_id", F.lit("").alias("chat_title"), F.coalesce("sender_id", F.lit(0)).cast("long").alias("author_id"), "sent_at", F.col("text").alias("normalized_text"),
                     F.when(F.col("text") == "", 0).otherwise(1).alias("token_count"), "is_outgoing", F.lit("").alias("media_kind"))
    rows = spark.createDataFrame(rows.collect(), INPUT)
    expected = sorted((r.first_message_id, r.message_count, r.text) for r in sessions.build_utterances(rows).collect())
    # a late row per chat pushes the watermark past everything else
    last = [(900 + c, 9000, c, "", 99, START + timedelta(days=400 + k), "end", 1, False, "") for k in range(2) for c in (1, 2, 3)]
    path = files(rows, tmp_path / "turns", "sent_at")
    spark.createDataFrame(last[:3], INPUT).coalesce(1).write.mode("append").parquet(path)
    stream = ingest.stream_messages(spark, path, rows.schema, files_per_batch=1)
    got = run(ingest.stream_utterances(stream), tmp_path, "turns")
    assert sorted((r.first_message_id, r.message_count, r.text) for r in got.collect() if r.first_message_id < 900) == expected


def test_bursts(spark, tmp_path):
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(1, 7, at + timedelta(seconds=s)) for s in (0, 100, 200, 1000)] + [(1, 8, at + timedelta(days=1))]
    path = files(spark.createDataFrame(rows, "chat_id long, sender_id long, sent_at timestamp"), tmp_path / "b", "sent_at")
    got = run(ingest.stream_burst_counts(ingest.stream_messages(spark, path, "chat_id long, sender_id long, sent_at timestamp", files_per_batch=1)), tmp_path, "bursts")
    assert sorted(r.n for r in got.where("sender_id = 7").collect()) == [1, 3]


class Values:
    """A state variable that counts its calls."""

    def __init__(self):
        self.held, self.calls = [], 0

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "exists":
                return bool(self.held)
            if name == "get":
                return iter([*self.held]) if not self.single else self.held[0]
            self.held = {"clear": lambda: [], "update": lambda v: [v], "put": lambda v: [*v], "appendValue": lambda v: [*self.held, v], "appendList": lambda v: [*self.held, *v]}[name](*given)

        return call


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def make(self, name, single):
        self.states[name] = v = Values()
        v.single = single
        return v

    def getValueState(self, name, schema):  # noqa: N802
        return self.make(name, True)

    def getListState(self, name, schema):  # noqa: N802
        return self.make(name, False)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_state_is_called_by_the_pack(monkeypatch):
    """5,000 rows that make 2,500 turns take a few calls of the state, in any packs, and a turn goes on over timers."""
    said = Row("sent_us", "telegram_id", "id", "author_id", "is_outgoing", "normalized_text", "token_count", "media_kind")
    rows = [said(i * 1_000_000, i, i, i // 2 % 2, False, f"w{i}", 1, "voice" if i % 10 == 0 else "") for i in range(5000)]
    results = []
    for pack, cuts in ((1 << 10, (5001,)), (1, (1001, 1002, 2000, 5001)), (7, (5001,))):
        monkeypatch.setattr(ingest, "_PACK_ROWS", pack)
        handle, turns, got = Handle(), ingest.Turns(120_000_000), []
        turns.init(handle)
        assert [*turns.handleInputRows((1,), iter(rows[::-1]), Clock(0))] == [] and handle.timers == [0]
        for cut in cuts:
            got += turns.handleExpiredTimer((1,), Clock(cut * 1000), None)
        got += turns.handleExpiredTimer((1,), Clock(10_000_000), None)
        results.append(got)
        if pack == 1 << 10:
            assert sum(v.calls for v in handle.states.values()) < 40
        assert not any(v.held for v in handle.states.values())
    assert results[0] == results[1] == results[2] and len(results[0]) == 2500
    assert results[0][0].asDict() == {"chat_id": 1, "first_message_id": 0, "author_id": 0, "is_outgoing": False, "started_us": 0, "ended_us": 1_000_000, "message_count": 2, "text": "w0 w1", "voice_count": 1}
