"""Signals of some kinds only."""

from chatloom.operators import layers


def test_only_the_asked_kinds_are_made(spark):
    texts = ["ok ok!! 😂", "АААА", "", None, "нет..."]
    rows = spark.createDataFrame([(i + 1, t, "sticker" if t == "" else "") for i, t in enumerate(texts)], "id long, text string, media_kind string")
    kinds = ("emoji_usage", "slang_markers")
    some = layers.extract_signals(rows, kinds)
    assert sorted(some.collect()) == sorted(r for r in layers.extract_signals(rows).collect() if r.signal_type in kinds)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "sig__emoji" in plan and "sig__runs" not in plan and "sig__caps" not in plan
