"""Top-k search over the posting index equals scoring everything, and scores less."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import postings, ranking

TURNS = "first_message_id long, text string, message_count int, is_outgoing boolean, chat_id long, position long"


def turns(spark, texts):
    return spark.createDataFrame([(i, t, 1, True, 1, i) for i, t in enumerate(texts)], TURNS)


def corpus(n=3000):
    """Few frequent words, many rare ones, texts of all lengths, copies, texts without words."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    share = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, share, k=rng.choice((1, 3, 10, 40, 200)))) for _ in range(n)]
    return [*texts, *[texts[0]] * 40, None, "", "  !? ", "w0 " * 5000]


@pytest.fixture(scope="module")
def known(spark):
    docs = turns(spark, corpus()).cache()
    return docs, postings.build_index(docs)


def asked(spark):
    return spark.createDataFrame([(1, "w0 w1"), (2, "w399 w3 w3"), (3, "w250"), (4, "nowhere"), (5, "w0 nowhere W7, w12"), (6, "w1 w2 w5 w90 w201")], "query_id long, query string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.first_message_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("scaled", [True, False])
@pytest.mark.parametrize("limit", [1, 10, 700])
def test_first_rows(spark, known, scaled, limit):
    docs, index = known
    every = ranking.bm25_reranked(asked(spark), docs) if scaled else ranking.bm25(asked(spark), docs)
    expected = ranking.with_rank(every.withColumn("score", F.round("score", 6)), limit)
    assert rows(postings.top_hits(asked(spark), index, limit, scaled, 6)) == rows(expected)


def test_whole_lists(spark, known):
    docs, index = known
    for scaled, every in ((True, ranking.bm25_reranked(asked(spark), docs)), (False, ranking.bm25(asked(spark), docs))):
        found = {(r.query_id, r.first_message_id): round(r.score, 6) for r in postings.scores(asked(spark), index, scaled).collect()}
        assert found == {(r.query_id, r.first_message_id): round(r.score, 6) for r in every.collect()}


def test_blocks_are_left_out(spark, known):
    _, index = known
    asked_, live = postings.candidate_blocks(asked(spark), index, 3)
    every = asked_.join(index.blocks, "term").select("query_id", "block").distinct()
    assert live.count() < every.count() / 2
    assert index.blocks.agg(F.countDistinct("block")).first()[0] > 20


def test_no_documents_and_no_words(spark):
    for texts in ([], [None, "", "?!"]):
        docs = turns(spark, texts)
        index = postings.build_index(docs)
        assert index.docs == len(texts)
        assert postings.top_hits(asked(spark), index).count() == 0
        assert postings.retrieve(asked(spark), index, docs).count() == 0


def test_retrieve_joins_turns_and_refuses_blank_queries(spark, known):
    docs, index = known
    found = postings.retrieve(asked(spark), index, docs, limit=0)
    assert found.where("query_id = 1").count() == 10 and "text" in found.columns
    with pytest.raises(ValueError, match="blank"):
        postings.retrieve(spark.createDataFrame([(1, " ")], "query_id long, query string"), index, docs)


def test_first_lists_are_those_of_whole_lists(spark, known):
    """Without a whole list: rows of the vector list far down the lexical one, not in it, of equal scores, queries without either."""
    docs, _ = known
    digits = 2  # many equal scores
    rng = random.Random(5)
    near = spark.createDataFrame([(q, i, round(rng.random(), 1)) for q in (1, 3, 4, 6) for i in rng.sample(range(3044), 30)], "query_id long, first_message_id long, score double")
    every = ranking.bm25_reranked(asked(spark), docs).withColumn("score", F.round("score", digits)).where("score > 0")
    hybrid = ranking.hybrid_rrf(every, near).withColumn("score", F.round("score", 9))
    found = ranking.first_lists(asked(spark), docs, near, 10, digits)
    for got, expected in zip(found, (every, near, hybrid), strict=True):
        own = lambda df: sorted((r.query_id, r["rank"], r.first_message_id) for r in df.collect())
        assert own(got) == own(ranking.with_rank(expected, 10))


def test_a_tasks_words_are_counted_text_by_text():
    """No table of (text, term) is kept: rows come out for each slice of texts."""
    import pyarrow as pa

    texts = [["b", "a", "b"], None, [], ["a"]] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(2400)), pa.array(texts, pa.list_(pa.string())), pa.array([0.5] * 2400)], ["first_message_id", "tokens", "factor"])
    parts = list(postings._count_words(iter([batch.slice(0, 2400)])))
    assert len(parts) == 3
    got = sorted(tuple(r.values()) for p in parts for r in p.to_pylist())
    assert got == sorted((i, 0.5, len(t), w, t.count(w)) for i, t in enumerate(texts) if t for w in set(t))
