"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays in one shard. Groups, sorted by size, largest first, go
to the shard with the least bytes, which a heap keeps on top. The heap need not see the groups one
by one: groups of one size are interchangeable, so the driver gets the number of groups of each
size and deals whole runs of them; which groups of a run a shard gets follows from their rank
within the run, which Spark finds without gathering a run in one place. Sizes of 2^12 bytes and more count in
runs by their first twelve binary digits, so there are at most 4,096 + 2,048 x 52 runs whatever the
data. A run's groups then count as its mean size; before the smaller groups, whose sizes are exact,
are dealt, the shards' loads are summed anew, so that they even out what rounding left.

Null texts are in the group of empty texts. A group is known by a 64-bit hash of its text; were two texts
to share it, they would stay together, which no rule forbids. Repeated rows each get a slot of their own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .shared import materialise

#: Binary digits of a size that runs tell apart.
DIGITS = 12
#: Copies of one row that a task writes at once.
COPIES = 1 << 16


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of one size each shard gets, each going to the least load (ties: first shard)."""
    got = [0] * len(loads)
    if count > 4 * len(loads):  # up to a level t each shard takes what it can start below t

        def started(t: int) -> list[int]:
            return [max(0, -((load - t) // size)) for load in loads]

        low, high = min(loads), max(loads) + size * count
        level = low + bisect_right(range(low, high), count, key=lambda t: sum(started(t))) - 1
        got = started(level)
    heap = [(load + k * size, i) for i, (load, k) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
        got[i] += 1
    return got


def schedule(runs: list[tuple[int, int, int]], loads: list[int]) -> list[tuple[int, list[int]]]:
    """(run, ends of the shards' shares of it) for runs (name, groups, bytes), largest sizes first.

    loads, the bytes of each shard, is brought up to date.
    """
    out = []
    for run, count, total in runs:
        size = total // count
        got = deal(loads, size, count)
        ends, n = [], 0
        for i, k in enumerate(got):
            loads[i] += k * size
            n += k
            ends.append(n)
        out.append((run, ends))
    return out


def _text(docs: DataFrame):
    return F.coalesce(docs["text"], F.lit(""))


def _run():
    """A size's run; runs of larger sizes have larger names."""
    shift = F.greatest(F.length(F.bin("bytes")) - DIGITS, F.lit(0))
    return (shift * (1 << DIGITS)).cast("long") + F.call_function("shiftright", F.col("bytes"), shift)


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, bytes, shard) for groups (key, bytes), each key once and bytes at least 1."""
    spark = groups.sparkSession
    groups = groups.withColumn("run", _run())
    runs = [tuple(r) for r in groups.groupBy("run").agg(F.count("*"), F.sum("bytes")).orderBy(F.desc("run")).collect()]
    loads, parts, exact = [0] * shards, [], 1 << DIGITS
    for some in ([r for r in runs if r[0] >= exact], [r for r in runs if r[0] < exact]):
        if not some:
            continue
        if parts:  # what the shards really hold
            for r in parts[0].groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
                loads[r.shard] = r.bytes
        plan = spark.createDataFrame(schedule(some, loads), "run long, ends array<long>")
        own = groups.where(F.col("run") >= exact if some[0][0] >= exact else F.col("run") < exact)
        ranked = numbered(own, ["run"], ["key"], sum(r[1] for r in some), "place")
        shard = F.size(F.filter("ends", lambda end: end <= F.col("place")))
        parts.append(materialise(ranked.join(F.broadcast(plan), "run").select("key", "bytes", shard.alias("shard")), "shards"))
    if not parts:
        return groups.select("key", "bytes", F.lit(0).alias("shard"))
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]


def group_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(key, bytes, shard) of each group of rows of docs (text string) with equal texts; key is xxhash64 of the text."""
    rows = docs.select(F.xxhash64(_text(docs)).alias("key"), (F.octet_length(_text(docs)) + 1).cast("long").alias("size"))
    return assign_groups(materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups"), shards)


def add_shard(docs: DataFrame, shards: int = 16, out: str = "shard") -> DataFrame:
    """docs with its rows' shard in a new int column out, ready for writing by partition."""
    found = group_shards(docs, shards).select(F.col("key").alias("shard__key"), F.col("shard").alias("shard__of"))
    keyed = docs.withColumn("shard__key", F.xxhash64(_text(docs)))
    return keyed.join(found, "shard__key").select(*docs.columns, F.col("shard__of").alias(out))


def place_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of each row of docs (doc_id, text).

    size is the text's bytes in UTF-8 and one more. Slots run from 0 without a gap in each shard.
    """
    text = _text(docs)
    plain = docs.select("doc_id", F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(plain.groupBy(*plain.columns).agg(F.count("*").alias("copies")), "rows")
    groups = materialise(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "groups")
    found = assign_groups(groups, shards).select("key", "shard")
    placed = materialise(numbered(rows.join(found, "key"), ["shard"], ["doc_id", "key"], rows.count(), "slot", weight="copies"), "slots")
    # copies of one row in chunks, so that no task writes all of them
    many = placed.where(F.col("copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("chunk")).repartition("key", "doc_id", "chunk")
    left = F.least(F.lit(COPIES), F.col("copies") - F.col("chunk") * COPIES)
    few = placed.where(F.col("copies") <= COPIES).withColumn("chunk", F.lit(0).cast("long"))
    out = [d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("copy")) for d in (few, many)]
    slot = F.col("slot") + F.col("chunk") * COPIES + F.col("copy")
    return out[0].union(out[1]).select("doc_id", "size", "text_crc32", "law", "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
