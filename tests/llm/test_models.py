"""The two learned operators against plain loops: longest matches by substring search, word vectors by counting."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

import __spark_entry__
from chatloom.llm import langid, quality
from chatloom.llm.words import mix

CRC = "crc32(cast(cast(doc_id as string) as binary))"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cleaned(text):
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode())


def phrases(sample, text):
    """Greedy longest phrases of each segment that occur in the sample; an unknown byte is one of its own."""
    n = 0
    for at in range(0, len(text), langid.SEGMENT):
        n, match = n + 1, b""
        for x in text[at : at + langid.SEGMENT]:
            one = bytes([x])
            if match + one in sample:
                match += one
            else:
                n, match = n + 1, one if one in sample else b""
    return n


def test_language_by_substring_search(spark, sf):
    docs = table(spark, sf, "documents")
    sample = {k: cleaned(v.lower()) for k, v in langid.training_sample(docs, F.expr(f"{CRC} % 4 != 2")).items()}
    texts = {r.doc_id: r.text for r in docs.where("length(text) < 3000").limit(80).collect()}
    for r in __spark_entry__.queries()["op10_language_id"](spark, sf).collect():
        if r.doc_id not in texts:
            continue
        low = pc.utf8_lower(pa.scalar(texts[r.doc_id] or "")).as_py()
        if not any(map(str.isalpha, low)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = sorted((phrases(s, cleaned(low)), label) for label, s in sample.items())
        assert r.lang_pred == counts[0][1]
        assert abs(r.score - (1 - counts[0][0] / max(counts[1][0], 1))) < 1e-12


def test_language_does_not_depend_on_neighbours(spark, sf):
    sample = langid.training_sample(table(spark, sf, "documents"), F.lit(True))
    texts = ["one. ", " two three", "", "... vier fuenf!", "seis siete "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    together = sorted(map(tuple, langid.identify(rows.coalesce(1), sample).collect()))
    alone = sorted(tuple(r) for i in range(len(texts)) for r in langid.identify(rows.where(f"doc_id = {i}"), sample).collect())
    assert together == alone


def plain_tokens(text):
    """Buckets of the runs of upper-case letters, lower-case and other letters, digits, or one sign; white space parts them."""
    out = []
    for m in re.finditer(rb"(?s)[A-Z]+|[a-z\x80-\xff]+|[0-9]+|[ \x09-\x0d]+|(.)\1*", (text or "").encode()):
        if not re.match(rb"[ \x09-\x0d]", m[0]):
            total = sum(int(quality._VALUE[x]) * int(quality._PLACE[min(i, 63)]) for i, x in enumerate(m[0])) % 2**64
            out.append(int(mix(np.array([total], np.uint64))[0]) % quality.BUCKETS)
    return out


def test_quality_by_counting(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    tokens = [(r.doc_id, plain_tokens(r.text)) for r in docs.collect()]
    places, signs = quality.index_vectors()
    total, seen = np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros(quality.BUCKETS)
    index = np.zeros((quality.BUCKETS, quality.DIMS))
    for b in range(quality.BUCKETS):
        for p, s in zip(places[b], signs[b], strict=True):
            index[b, p] += s
    for _, t in tokens:
        for i, a in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    total[a] += index[t[j]]
                    seen[a] += 1
    vectors = np.divide(total, seen[:, None], where=seen[:, None] > 0, out=np.zeros_like(total)).astype(np.float32)
    assert np.array_equal(vectors, quality.word_vectors(docs))

    blank = np.zeros(quality.FEATURES)
    features = {d: np.concatenate([vectors[t].mean(0, np.float64), vectors[t].std(0, dtype=np.float64)]) if t else blank for d, t in tokens}
    taught = labels.where(f"quality is not null and doc_id is not null and {CRC} % 3 != 1").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).sort("h").collect()
    taught = [r for r in taught if r.doc_id in features]
    net = quality.Network(np.array([features[r.doc_id] for r in taught]), np.array([r.quality for r in taught], float), np.array([r.h % 5 == 0 for r in taught]))
    got = __spark_entry__.queries()["op4_quality"](spark, sf).collect()
    assert len(got) == len(tokens)
    for r in got:
        want = float(net.score(features[r.doc_id][None])[0])
        assert abs(r.score - want) < 0.02, r  # sums of 32-bit numbers here, of 64-bit ones there
