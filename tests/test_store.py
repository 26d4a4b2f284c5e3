"""Versioned layer stores: merges, replays, growth and batches that died."""

import random
from pathlib import Path

from chatloom.sources import store

SCHEMA = "k long, part long, a string, b string"


def rows_of(df):
    return sorted(map(tuple, df.select("k", "part", "a", "b").collect()))


def test_merges_equal_a_dict(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 4)
    monkeypatch.setattr(store, "ROWS", 8)
    rng = random.Random(2)
    kept = store.LayerStore(spark, f"file://{tmp_path}/s", ["k", "part"], ["a"], "part")
    assert kept.read() is None
    known, batches = {}, []
    for number in range(6):
        keys = {(rng.randint(0, 60), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(25)}
        keys = {(k, p) for k, p in keys if p is not None}
        rows = [(k, p, f"a{number}", f"b{number}") for k, p in sorted(keys)]
        batches.append(spark.createDataFrame(rows, SCHEMA))
        for k, p, a, b in rows:
            known[k, p] = (a, known[k, p][1] if (k, p) in known else b)
        kept.merge(batches[-1], number)
        if number:  # the one before comes again
            kept.merge(batches[-2], number - 1)
        assert rows_of(kept.read()) == sorted((*k, *v) for k, v in known.items())
    assert kept._newest()[0].buckets > 4


def test_untouched_buckets_stay(spark, tmp_path):
    kept = store.LayerStore(spark, f"file://{tmp_path}/s", ["k"], ["a", "b"], "part")
    kept.merge(spark.createDataFrame([(i, i, "x", "y") for i in range(40)], SCHEMA), 0)
    kept.merge(spark.createDataFrame([(7, 7, "new", "y")], SCHEMA), 1)
    assert len(list(Path(tmp_path, "s", "data-1").glob("bucket=*"))) == 1
    assert {r.version for r in kept._newest()} == {0, 1}
    assert [r.a for r in kept.read().where("k = 7").collect()] == ["new"] and kept.read().count() == 40


def test_a_batch_that_died(spark, tmp_path):
    kept = store.LayerStore(spark, f"file://{tmp_path}/s", ["k"], ["a", "b"], "part")
    kept.merge(spark.createDataFrame([(1, 1, "x", "y")], SCHEMA), 0)
    # data without a manifest does not count, and is written over
    spark.createDataFrame([(9, 9, "lost", "y", 3)], f"{SCHEMA}, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/s/data-1")
    assert kept.read().count() == 1
    kept.merge(spark.createDataFrame([(2, 2, "x", "y")], SCHEMA), 1)
    assert sorted(r.k for r in kept.read().collect()) == [1, 2]
    kept.merge(spark.createDataFrame([], SCHEMA), 2)
    assert sorted(r.k for r in kept.read().collect()) == [1, 2]


def test_a_batch_is_written_once_and_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 1)
    kept = store.LayerStore(spark, f"file://{tmp_path}/s", ["k", "part"], ["a"], "part")
    rows_in = lambda name: spark.read.parquet(f"{tmp_path}/s/{name}").count() if Path(tmp_path, "s", name).exists() else 0
    for number in range(7):
        kept.merge(spark.createDataFrame([(k, 1, f"a{number}", f"b{number}") for k in range(number, number + 3)], SCHEMA), number)
        assert rows_in(f"data-{number}") == 3 and kept.batch(number, kept.read()).count() == 3  # what the bucket held is not written again
        assert rows_of(kept.read()) == sorted((k, 1, f"a{min(k, number)}", f"b{max(0, k - 2)}") for k in range(number + 3))
    assert len(kept._newest()) <= store.PARTS + 1 and rows_in("data-4-old") == 6


def test_a_batch_without_a_column(spark, tmp_path):
    kept = store.LayerStore(spark, f"file://{tmp_path}/s", ["k"], ["a", "b"], "part")
    kept.merge(spark.createDataFrame([(1, 1, "x", "y"), (2, 2, "x", "y")], SCHEMA), 0)
    kept.merge(spark.createDataFrame([(2, 2, "new"), (3, 3, "new")], "k long, part long, a string"), 1)
    assert sorted(map(tuple, kept.read().select("k", "a", "b").collect())) == [(1, "x", "y"), (2, "new", "y"), (3, "new", None)]
