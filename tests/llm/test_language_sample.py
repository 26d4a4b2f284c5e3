"""What the language models learn from."""

from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import langid


def test_sample_covers_all_texts(spark):
    """64 long texts under one header, among copies and empty texts: each teaches, to its end."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03d}")
    header = "common header of the source " * 100
    rows = [(i, f"{header}{(word(i) + 'begin ') * 1000}{(word(i) + 'final ') * 1000}", "xx") for i in range(64)]
    rows += [(1000 + i, "a copy " * 50, "xx") for i in range(300)] + [(2000 + i, t, "xx") for i, t in enumerate(["", None, " \n", "12 !"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sample = langid.training_sample(docs, F.lit(True))["xx"]
    assert 23_000 <= len(sample) <= 24_000 + 3 * 64  # blanks between the windows
    # at most one of the 64 gives its place to the copies
    assert sum(f"{word(i)}final" in sample for i in range(64)) >= 60
    assert sample.count("copy") <= 100 and sample.count("header") < 200


def test_nothing_learned(spark, sf):
    rows = [(0, "some text", None), (1, "12 34", None), (2, None, None), (3, "é", None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()) == [0, 3]
