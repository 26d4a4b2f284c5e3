"""Block search of full-text queries against the definition in search.full_text."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.operators import search, spots


@pytest.mark.parametrize("texts_a_block", [7, 1000])
def test_best_matches_are_the_first_of_all(spark, monkeypatch, texts_a_block):
    monkeypatch.setattr(spots, "TEXTS", texts_a_block)
    r = random.Random(5)
    words = ["or", *"abcdefgh"]
    texts = [(i, " ".join(r.choice(words[1:]) for _ in range(r.choice((0, 1, 3, 9, 40)))) if i % 17 else None, i // 3) for i in range(400)]
    item = lambda: r.choice(("{}", "{}", '"{} {}"', "-{}", '-"{} {}"', "or", "zz", '"{} {} {}"')).format(*r.choices("abcdefgh", k=3))
    asked = [(i, " ".join(item() for _ in range(r.randint(1, 4)))) for i in range(150)] + [(150, "a"), (151, "a"), (152, ""), (153, None), (154, "a -a"), (155, '"a a"')]
    df = spark.createDataFrame(texts, "id long, text string, at long").withColumn("at", F.timestamp_seconds("at"))
    queries = spark.createDataFrame(asked, "query_id long, query string")
    every = search.full_text(df, queries, "id", "text").join(df.select("id", "at"), "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.desc("at"), "id")
    want = every.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "id", "rank").collect()
    got = search.best_matches(df, queries, "id", "text", "at", 5).select("query_id", "id", "rank").collect()
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_common_word_leaves_few_rows(spark):
    """2,000 texts match each of 50 queries; a task hands on `limit` rows a wording."""
    df = spark.range(2000).select("id", F.lit("the same words").alias("text"), F.timestamp_seconds("id").alias("at"))
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.lit("the words").alias("query"))
    rows = df.select("id", F.unix_micros("at").alias("newer"), "text").coalesce(2)
    asked = search._slotted(queries.where("query_id < 1"))
    assert spots.best_texts(rows, asked, 3).count() <= 6
    top = search.best_matches(df, queries, "id", "text", "at", 3).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert len(top) == 50 and all(t.ids == [1997, 1998, 1999] for t in top)


def test_ranks_are_rounded_as_in_sql():
    x = np.concatenate([0.1 / 2.0 ** np.arange(1, 20), np.random.default_rng(1).random(2000), [0.1 / 3, 1.0000000005, 2.0000000015]])
    want = [float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in x]
    assert spots.rounded(x).tolist() == want


@pytest.mark.parametrize("texts_a_block", [7, 1000])
def test_best_reranked_are_the_first_of_bm25_reranked(spark, monkeypatch, texts_a_block):
    from chatloom.operators import ranking

    monkeypatch.setattr(spots, "TEXTS", texts_a_block)
    r = random.Random(6)
    texts = [(i, " ".join(r.choice("aaabbcdefgh") for _ in range(r.choice((0, 1, 3, 9, 200)))) + r.choice(("", " ...", "!"))) for i in range(300)] + [(300, None)]
    asked = [(i, " ".join(r.choices("abcdefghz", k=r.randint(1, 6)))) for i in range(40)] + [(40, "zz"), (41, "a")]
    turns = spark.createDataFrame(texts, "first_message_id long, text string").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    first = lambda hits: sorted(map(tuple, ranking.with_rank(hits, 5).select("query_id", "first_message_id", "score", "rank").collect()))
    want = first(ranking.bm25_reranked(queries, turns).withColumn("score", F.round("score", 6)).where("score > 0"))
    made = ranking.best_reranked(queries, turns, 5, 6)
    assert len(want) > 180 and first(made) == want
    assert made.groupBy("query_id").count().where("count > 5").isEmpty()  # one task hands on no more than the limit


def test_best_unscaled_are_the_first_of_bm25(spark):
    from chatloom.operators import ranking

    turns = spark.createDataFrame([(i, "a " * (i % 7) + "b " * (i % 5) + "c") for i in range(60)], "first_message_id long, text string")
    queries = spark.createDataFrame([(0, "a b"), (1, "c c a"), (2, "b")], "query_id long, query string")
    first = lambda hits: sorted(map(tuple, ranking.with_rank(hits, 4).select("query_id", "first_message_id", "score", "rank").collect()))
    assert first(ranking.best_reranked(queries, turns, 4, 6, scaled=False)) == first(ranking.bm25(queries, turns).withColumn("score", F.round("score", 6)))
