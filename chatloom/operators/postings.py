"""A stored posting table for BM25 with a best impact for each term in each block of documents, and top-k search that skips blocks.

Texts are tokenised once, when the index is made. Documents of about one length share a block, so what a term adds to a
score varies little within it. A block whose terms' best impacts add up to less than a score that `limit` documents
surely reach is never scored. Results are those of scoring everything. A first_message_id names one turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import stored
from .ranking import check_queries, with_rank

#: Documents of a block, on average, and length classes between x and 2 x tokens.
BLOCK, CLASSES = 128, 16
#: Blocks of each query that are scored first for a better threshold.
FIRST = 4
#: Relative allowance for sums of doubles in another order.
_SLACK = 1e-9


#: Texts whose words are counted at once, postings that a task aggregates.
TEXTS, ROWS = 1024, 1 << 20


@dataclass(frozen=True)
class PostingIndex:
    """postings (term, block, first_message_id, tf, dl, impact, factor), blocks (term, block, n, best, best_scaled) and the number of documents.

    impact is what an occurrence adds to a document's score before the term's idf; factor is the length factor of
    rerank_by_length, and best_scaled the best impact with it.
    """

    postings: DataFrame
    blocks: DataFrame
    docs: int


def build_index(utterances: DataFrame, k1: float = 1.2, b: float = 0.75, k: float = 10, cap: int = 100) -> PostingIndex:
    """The index of turns (first_message_id, text). Turns without words only count among the documents, null texts not in the mean length."""
    # a document's words are counted where its text is, so texts are shuffled, not their words
    spread = utterances.select("first_message_id", "text").repartition("first_message_id")
    tokens = spread.select("first_message_id", X.tokenize(F.col("text")).alias("tokens"), X.length_sigmoid(X.count_tokens(F.col("text")), k, cap).alias("factor"))
    kind = T.StructType([tokens.schema["first_message_id"], *T.StructType.fromDDL("factor double, dl int, term string, tf long").fields])
    raw = stored(tokens.mapInArrow(_count_words, kind), "postings")
    docs, texts = utterances.agg(F.count("*"), F.count("text")).first()
    length_class = F.floor(F.log2("dl") * CLASSES).cast("int")
    # a document's tf sum to its length, so its rows count as one document; there are at most CLASSES x 31 classes
    classes = raw.groupBy(length_class.alias("class")).agg(F.ceil(F.sum(F.col("tf") / F.col("dl")) / BLOCK).alias("wide"), F.sum("tf").alias("tokens"), F.count("*").alias("n")).collect()
    mean = sum(c.tokens for c in classes) / texts if texts else 0.0
    first, rows = 0, []
    for c in sorted(classes, key=lambda c: c["class"]):
        rows.append((c["class"], first, int(c.wide)))
        first += int(c.wide)
    placed = raw.withColumn("class", length_class).join(F.broadcast(raw.sparkSession.createDataFrame(rows, "class int, first long, wide long")), "class")
    block = F.col("first") + F.pmod(F.xxhash64("first_message_id"), F.col("wide"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    postings = placed.select("term", block.alias("block"), "first_message_id", "tf", "dl", impact.alias("impact"), "factor")
    # parts of ROWS rows, so that a task's aggregate does not grow with the table
    parts = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(c.n for c in classes) // ROWS)
    blocks = postings.select("term", "block", "impact", "factor").repartition(parts, "term", "block").groupBy("term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("best"), F.max(F.col("impact") * F.col("factor")).alias("best_scaled"))
    return PostingIndex(postings, stored(blocks, "posting-blocks"), docs)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first_message_id, factor, dl, term, tf) of texts (first_message_id, tokens, factor): a text's words are counted on the spot."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
            coded = batch.column("tokens").flatten().dictionary_encode()
            n = max(len(coded.dictionary), 1)
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(), return_counts=True)
            own = pa.array(key // n)
            columns = [batch.column("first_message_id").take(own), batch.column("factor").take(own), pa.array(sizes[key // n], pa.int32()), coded.dictionary.take(pa.array(key % n)), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["first_message_id", "factor", "dl", "term", "tf"])


def weights(queries: DataFrame, index: PostingIndex) -> DataFrame:
    """(query_id, term, weight): idf times how often the query has the term, for terms that occur."""
    terms = queries.select("query_id", F.explode(X.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = stored(terms, "query-terms")  # of known size, so that few terms are broadcast to the blocks
    df = index.blocks.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.join(df, "term").select("query_id", "term", (idf * F.col("times")).alias("weight"))


def _scores(pairs: DataFrame, asked: DataFrame, index: PostingIndex, scaled: bool) -> DataFrame:
    """(query_id, first_message_id, score) of all documents in the pairs (query_id, block)."""
    add = F.col("weight") * F.col("impact")
    own = index.postings.join(asked.select("term"), "term", "left_semi")  # before anything is shuffled
    rows = pairs.select("query_id", "block").join(asked, "query_id").join(own, ["term", "block"])
    found = rows.groupBy("query_id", "first_message_id").agg(F.sum(add).alias("score"), F.first("factor").alias("factor"))
    return found.select("query_id", "first_message_id", (F.col("score") * F.col("factor") if scaled else F.col("score")).alias("score"))


def scores(queries: DataFrame, index: PostingIndex, scaled: bool = False) -> DataFrame:
    """(query_id, first_message_id, score > 0) of every turn with a word of the query: bm25, scaled: with rerank_by_length."""
    asked = weights(queries, index)
    found = index.postings.join(asked, "term").groupBy("query_id", "first_message_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"), F.first("factor").alias("factor"))
    score = F.col("score") * F.col("factor") if scaled else F.col("score")
    return found.select("query_id", "first_message_id", score.alias("score")).where(F.col("score") > 0)


def candidate_blocks(queries: DataFrame, index: PostingIndex, limit: int, scaled: bool = True, near: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(asked, live): the queries' weights, and the blocks (query_id, block, bound) that can hold one of a query's first rows."""
    asked = stored(weights(queries, index), "query-weights")
    gain = F.col("weight") * F.col("best_scaled" if scaled else "best")
    gains = asked.join(index.blocks, "term").select("query_id", "term", "block", gain.alias("gain"))
    # blocks share no document, so a term's limit-th best block is a score that limit documents reach
    order = Window.partitionBy("query_id", "term").orderBy(F.desc("gain"))
    sure = gains.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).where(F.col("nth") == limit).groupBy("query_id").agg(F.max("gain").alias("sure"))
    bounds = gains.groupBy("query_id", "block").agg(F.sum("gain").alias("bound"))
    reach = F.col("bound") * (1 + _SLACK) + near >= F.coalesce("sure", F.lit(0.0))
    live = stored(bounds.join(sure, "query_id", "left").where(reach).select("query_id", "block", "bound"), "live-blocks")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = live.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FIRST)
    scored = _scores(first, asked, index, scaled)
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    sure = scored.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") <= limit).where(F.col("nth") == limit).select("query_id", F.col("score").alias("sure"))
    return asked, live.join(sure, "query_id", "left").where(reach).select("query_id", "block", "bound")


def top_hits(queries: DataFrame, index: PostingIndex, limit: int = 10, scaled: bool = True, digits: int | None = None) -> DataFrame:
    """(query_id, first_message_id, score, rank): the first rows of bm25 (scaled: with rerank_by_length), scores above zero, ties to the smaller id.

    With digits, scores are rounded before they are ranked.
    """
    asked, live = candidate_blocks(queries, index, limit, scaled, 0.0 if digits is None else 10.0**-digits)
    hits = _scores(live, asked, index, scaled).where(F.col("score") > 0)
    return with_rank(hits if digits is None else hits.withColumn("score", F.round("score", digits)), limit)


def retrieve(queries: DataFrame, index: PostingIndex, utterances: DataFrame, limit: int = 10, digits: int | None = None) -> DataFrame:
    """As ranking.retrieve with bm25_reranked over the indexed turns, which are joined after the first rows are known."""
    check_queries(queries)
    return top_hits(queries, index, limit if limit > 0 else 10, True, digits).join(utterances, "first_message_id")
