"""The pipeline's stages, each against what it promises, and the n-gram join against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chatloom.llm import decontaminate, ngram_jaccard, topk, url_filters

from . import brute
from .test_contracts import empty, odd  # noqa: F401


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@pytest.mark.parametrize("page", [128, 4])
def test_op2(spark, sf, monkeypatch, page):
    """Also with pages so small and keys so crowded that groups span many pages."""
    if page == 4:
        monkeypatch.setattr(ngram_jaccard, "PAGE", 4)
        monkeypatch.setattr(ngram_jaccard, "SMALL", 2)
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(documents(spark, sf)).collect()}
    assert out == brute.components(texts)


def test_op2_chains_and_many_copies(spark):
    """Near copies in a chain, where the ends are not linked, and a large group of near copies."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(f"x{j}" if j != i else "odd" for j in range(120))) for i in range(60)]
    rows += [(200 + i, " ".join(f"y{j + 17 * i}" for j in range(n))) for i, n in enumerate((1, 2, 4, 5, 6, 9, 63, 64, 65, 127, 128))]
    rows += [(300 + i, " ".join(f"y{j + 17 * i}" for j in range(n + 1))) for i, n in enumerate((1, 2, 4, 5, 6, 9, 63, 64, 65, 127, 128))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df).collect()}
    assert out == brute.components(dict(rows))


def test_op2_odd_rows(spark, odd):  # noqa: F811
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(documents(spark, odd)).collect()]
    got = {d: c for d, _, c in out if d is not None}
    assert len(out) == documents(spark, odd).count()
    assert got[0] == 0 and got[1] == 1 and got[4] == 4 and got[5] == got[6] == 5 and got[9] == got[10] == got[11] == 9
    assert [c for d, _, c in out if d is None] == [None]


def test_stages(spark, sf):
    docs = documents(spark, sf).cache()
    columns = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, sf).cache()
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}

    one = corpus_pipeline.near_duplicates(spark, kept, sf)
    comps = brute.components({r.doc_id: r.text for r in kept.collect()})
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (n, c) in comps.items() if d == c or not n)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    expected = []
    for r in docs.collect():
        n, hit, _ = brute.passages(r.text, items)
        if not (hit and 20 * hit >= n):
            expected.append(r.doc_id)
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(expected)

    docs = documents(spark, sf.replace("0.001", "0.01"))  # the smallest table has no secrets
    safe = corpus_pipeline.secrets(spark, docs, sf)
    before = {r.doc_id: r.text for r in docs.collect()}
    found = False
    for r in safe.collect():
        spans = brute.base_spans(before[r.doc_id])
        found |= bool(spans)
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        assert spans or "[SECRET]" in r.text or r.text == before[r.doc_id]
    assert safe.columns == columns and found


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_whole_pipeline_on_odd_tables(spark, request, which):
    d = request.getfixturevalue(which)
    out = __spark_entry__.queries()["pipeline"](spark, d)
    rows = out.collect()
    assert (len(rows) == 0) is (which == "empty")
    if rows:  # texts without letters, copies and benchmark texts ("beta gamma" is an item) are gone
        ids = [r.doc_id for r in rows]
        assert {7, 12, 13, 14, 15, 16} <= set(ids) and not {0, 1, 4, 5, 6, 8, 9, 10, 11} & set(ids) and len(ids) == len(set(ids))


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, None, "n"), (2, "", "n"), (3, "other words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string")
    out = sorted(map(tuple, ngram_jaccard.keep_one(df).collect()), key=str)
    assert [r[:2] for r in out] == [(1, "a b c d e f"), (2, ""), (2, None), (3, "other words")]


def test_benchmark_in_several_blocks(spark, sf, monkeypatch):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.passage_digest(decontaminate.find_passages(docs, items)).collect()))
    kept = sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 100)
    assert sorted(map(tuple, decontaminate.passage_digest(decontaminate.find_passages(docs, items)).collect())) == whole
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == kept


def test_queries_in_several_blocks(spark, sf):
    rows = topk.quantise(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    asked = rows.where(F.col("id") % 20 == 0)
    whole = sorted(map(tuple, topk.top_k(asked, rows, 7).collect()))
    assert sorted(map(tuple, topk.top_k(asked, rows, 7, query_block=5).collect())) == whole


def test_mined_rules(spark):
    """A host that labels block is learned, a harmless one is not."""
    bad = [(i, f"http://www.cheap.example.com/en/{i}") for i in range(30)]
    good = [(i, f"http://www.good.example.com/en/{i}") for i in range(30, 200)]
    pages = spark.createDataFrame([*bad, *good, (900, "http://new.cheap.example.com/xx/1"), (901, "http://good.example.com/en/5")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 30) for i in range(200)], "id long, blocked boolean")
    out = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, labels, ()).collect()}
    assert out[0] == "block" and out[900] == "block" and out[50] == "allow" and out[901] == "allow"


def test_top_k_repeated_queries_and_dealt_packs(spark, monkeypatch):
    """Repeated query rows are answered as often as they occur; packs too large to broadcast give the same rows; odd widths, chunks of one."""
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(rng.choice((1, 4, 7)))]) for i in range(300)] + [(400, []), (401, [0.0, 0.0])]
    asked = [vectors[i] for i in (0, 0, 0, 7, 31, 31)] + [(31, [1.0, 2.0]), (400, [])]
    schema = "vec_id long, embedding array<double>"
    rows, queries = (topk.quantise(spark.createDataFrame(x, schema), "vec_id", "embedding") for x in (vectors, asked))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    expected = []
    for q, v in asked:
        ints = [math.floor(1024 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(ints, w, strict=False)), i) for i, w in whole.items() if i != q)[:5]
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    found = lambda **more: sorted(map(tuple, topk.top_k(queries, rows, 5, **more).collect()))
    assert found() == sorted(expected)
    monkeypatch.setattr(topk, "BROADCAST", 0)
    assert found(query_block=2) == sorted(expected)
    assert topk.top_k(queries.limit(0), rows, 5).count() == topk.top_k(queries, rows.limit(0), 5).count() == 0
