"""Whole fused lists equal those of plain ranking, and their rows are shuffled in packs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.operators import ranking, spots
from chatloom.queries import catalog

from .test_postings import asked, corpus, turns


def near(spark):
    """Rows with and without a place in the lexical list; turns 3040 to 3042 have no words, query 4 has no match, query 9 is not asked."""
    rng = random.Random(3)
    ids = {q: [*rng.sample(range(3040), 12), 3040, 3042] for q in (1, 3, 4, 6, 9)}
    return spark.createDataFrame([(q, i, round(rng.random(), 1)) for q, own in ids.items() for i in own], "query_id long, first_message_id long, score double")


@pytest.mark.parametrize(("part", "queries"), [(1, 1), (40, 2), (1 << 17, 8192)])
def test_whole_lists_are_those_of_plain_ranking(spark, monkeypatch, part, queries):
    monkeypatch.setattr(ranking, "PART", part)
    monkeypatch.setattr(spots, "QUERIES", queries)
    docs = turns(spark, corpus())
    docs = docs.withColumn("first_message_id", F.when(F.col("first_message_id") == 7, 1 << 40).when(F.col("first_message_id") == 8, -5).otherwise(F.col("first_message_id")))
    vector = near(spark)
    for digits in (1, 6):  # one place: many equal scores, some of them 0
        plain = ranking.bm25_reranked(asked(spark), docs).withColumn("score", F.round("score", digits))
        own = lambda df: sorted((r.query_id, r.first_message_id, r.score) for r in df.collect())
        assert own(ranking.hybrid_lists(asked(spark), docs, vector, digits)) == own(ranking.hybrid_rrf(plain, vector))


def test_no_turns_no_words_no_vectors(spark):
    none = near(spark).limit(0)
    for texts in ([], [None, "", "?!"]):
        assert ranking.hybrid_lists(asked(spark), turns(spark, texts), none).count() == 0
    some = ranking.hybrid_lists(asked(spark), turns(spark, [None, "?!"]), near(spark))
    assert some.count() == 70 and some.agg(F.min("score")).first()[0] == pytest.approx(1 / 74)
    assert ranking.hybrid_lists(asked(spark), turns(spark, ["w0 w9", "w1"]), none).where("query_id = 1").count() == 2


def test_packs_give_back_their_rows(monkeypatch):
    """Packs cut within a block, ids far apart, and what a row costs."""
    monkeypatch.setattr(ranking, "PACK", 700)
    rng = np.random.default_rng(1)
    ids = np.sort(np.concatenate([rng.choice(100_000, 998, replace=False), [-(1 << 50), 1 << 60]]))
    lists = {"query_id": [5, 3, 9], "wanted": [[int(ids[4]), 123456789], [], [int(ids[0]), int(ids[-1])]], "falls": [[0]] * 3, "above": [[0]] * 3}
    kept = ranking._Packs(pa.StructArray.from_arrays([pa.array(v) for v in lists.values()], list(lists)), 6)
    scores = [np.where(rng.random(1000) < 0.7, rng.random(1000) * 30, 0) for _ in range(3)]
    scores[0][4] = scores[2][0] = 0
    scores[2][-1] = 1
    for q, score in enumerate(scores):
        kept.query(q, score, ids)
    table = pa.Table.from_batches(kept.block())
    got, alone = {}, {}
    for query in (3, 5, 9):
        for above, into in ((0, got), (-1, alone)):
            own = table.filter(pa.compute.and_(pa.compute.equal(table["query_id"], query), pa.compute.equal(table["above"], above)))
            if own.num_rows:
                out = ranking._fuse(60)((pa.scalar(query), pa.scalar(above)), own)
                into[query] = dict(zip(out["first_message_id"].to_pylist(), out["score"].to_pylist(), strict=True))
    assert alone == {5: {int(ids[4]): 1 / 61}, 9: {int(ids[0]): 1 / 61}}
    for q, query in enumerate(lists["query_id"]):
        order = sorted((-round(s, 6), i) for s, i in zip(scores[q].tolist(), ids.tolist(), strict=True) if s > 0)
        expected = {i: 1 / (61 + n) for n, (_, i) in enumerate(order)}
        if query == 9:
            expected[int(ids[-1])] += 1 / 62
        assert got[query] == expected
    narrow = table.filter(pa.compute.equal(table["query_id"], 3))
    assert narrow["units"].nbytes < 6 * sum(narrow["n"].to_pylist())


def _records(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_rows_of_whole_lists_are_not_shuffled_one_by_one(spark, tmp_path):
    texts = [t for t in corpus() if t]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(2)
    spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = _records(spark)
    rows = catalog.QUERIES["hybrid_rrf"](spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    shuffled = sum(n for s, n in _records(spark).items() if s not in before)
    assert len(rows) > 30_000 and len({r.query_id for r in rows}) == -(-len(texts) // 100)
    assert shuffled < len(rows)
