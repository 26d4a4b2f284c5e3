"""Phrases, source audit and sharding against plain loops, and what they stand on."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chatloom.llm import collocations, divergence, numbering, quotient_filter, sharding

from . import brute
from .test_contracts import data, empty, odd, same, table  # noqa: F401

LANGS = (None, "en", "", "fr")


def texts(seed, n=300):
    """Rows (lang, source, text) with frequent phrases, ends of pieces everywhere, nulls and repeated rows."""
    r = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "ünï", "é-x", "a", "b1", "ſ", "\x00z", "İ"]
    rows = []
    for i in range(n):
        parts = [r.choice([" ".join(r.choices(words, k=r.randint(1, 4))), "new York City hall", "of the"]) + r.choice([" ", ". ", "\n", "\t", "  ", ",", " ", "\x0b"]) for _ in range(r.randint(0, 12))]
        rows.append((r.choice(LANGS), r.choice([None, "s1", "s2", "s3", "é"]), None if i % 41 == 0 else "".join(parts)))
    rows += [("en", "s1", "of the " * 300), ("de", "quiet", "?!"), ("de", None, None), ("en", "alone", ""), *rows[:20]]
    return rows


@pytest.mark.parametrize("block", [1 << 23, 200])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = texts(1)
    df = spark.createDataFrame([(lang, text, "x") for lang, _, text in rows], "lang string, text string, phrase string")
    for least, top in ((5, 2000), (30, 7)):
        got = collocations.phrases(df, 4, least, top)
        expected = brute.phrases([(lang, text) for lang, _, text in rows], 4, least, top)
        assert expected
        same(got, expected, ["lang", "rank", "phrase", "a", "l", "r", "n", "score"])


def test_split_words_in_slices(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 50)
    text = "Aé b. c d,e f\n" * 40 + "x" * 300 + " y z"
    parts = list(collocations._pieces_of(np.frombuffer(text.encode(), np.uint8)))
    assert b"".join(p.tobytes() for p in parts) == text.encode() and len(parts) > 5
    batch = collocations._block("en", parts, 7)
    words, sequence = batch.column("words")[0].as_py(), np.frombuffer(batch.column("sequence")[0].as_py(), "<u4")
    pieces = [p.split() for p in " ".join(words[i - 1] if i else "|" for i in sequence).split("|")]
    assert [p for p in pieces if p] == [p for p in ([*w.split()] for w in brute.re.split(r"[.,\n]", brute.lower(text))) if p]


def test_quotient_filter():
    r = np.random.default_rng(3)
    for widths in ((5, 5), (17, 34), (30, 30), (34, 34), (64, 64), (1, 1)):
        n = 2000
        left, right = (r.integers(0, 1 << min(w, 12), n).astype(np.uint64) << np.uint64(max(0, w - 12)) for w in widths)
        plain = {}
        for key in zip(left.tolist(), right.tolist(), strict=True):
            plain[key] = plain.get(key, 0) + 1
        filters = []
        for part in np.array_split(np.arange(n), 3):
            a, b = quotient_filter.permute(left[part], right[part], widths)
            filters.append(quotient_filter.pack(*quotient_filter.sum_equal(a, b, None, widths), widths))
        filters.append(quotient_filter.pack(*(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64)), widths))
        a, b, counts = quotient_filter.merge(filters, widths)
        again = quotient_filter.unpack(quotient_filter.pack(a, b, counts, widths))
        assert all((x == y).all() for x, y in zip((a, b, counts), again, strict=True))
        a, b = quotient_filter.restore(a, b, widths)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), counts.tolist(), strict=True)) == plain


@pytest.mark.parametrize("name", ["op11_collocations", "op12_divergence"])
def test_queries(spark, data, name):  # noqa: F811
    rows = [(r.lang, r.source, r.text) for r in table(spark, data, "documents").collect()]
    out = __spark_entry__.queries()[name](spark, data)
    if name.startswith("op11"):
        same(out, brute.phrases([(x, t) for x, _, t in rows]), ["lang", "rank", "phrase", "a", "l", "r", "n", "score"])
    else:
        same(out, brute.audit(rows), ["lang", "source", "part", "item", "value", "rank"])


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_audit(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "KEEP", 10)
    monkeypatch.setattr(divergence, "SLICE", 60)
    rows = texts(2)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int")
    for least, top in ((1, 3), (10, 50), (10_000, 50)):
        same(divergence.audit(df, least, top), brute.audit(rows, least, top), ["lang", "source", "part", "item", "value", "rank"])


def test_audit_of_large_counts(spark):
    """Products beyond 64 bits."""
    big = 9_000_000_000_000_000
    for n, total in ((big, 3 * big), (1, big), (0, 17)):
        got = spark.sql(f"select {divergence._share('n', 'total')} as p from (select cast({n} as bigint) as n, cast({total} as bigint) as total)").first().p
        assert got == 1 + 1_000_000_000 * (n + 5) // total


def test_numbers_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(numbering, "PART", 10)
    df = spark.range(200).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id", (F.col("id") % 4 + 1).alias("w"))
    for weight in (None, "w"):
        rows = numbering.numbered(df, ["k"], ["id"], 200, "n", weight).collect()
        assert len(rows) == 200
        for k in {r.k for r in rows}:
            at = 0
            for r in sorted((r for r in rows if r.k == k), key=lambda r: r.n):
                assert r.n == at
                at += r.w if weight else 1


def test_deal_is_one_by_one():
    r = random.Random(5)
    for _ in range(200):
        shards, size, count = r.randint(1, 9), r.randint(1, 50), r.randint(1, 300)
        loads = [r.randint(0, 2000) for _ in range(shards)]
        plain, got = list(loads), [0] * shards
        for _ in range(count):
            i = plain.index(min(plain))
            plain[i] += size
            got[i] += 1
        assert sharding.deal(loads, size, count) == got


def check_shards(rows, docs, shards):
    """Each row is there, equal texts are together, slots have no gap; returns the loads."""
    sizes = {}
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    loads, slots, of = [0] * shards, {}, {}
    for d, t in docs:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 1
        of.setdefault((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())), t or "")
    where = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert where.setdefault(of[str(r.doc_id), r["size"], r.text_crc32], r.shard) == r.shard
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sorted(loads), sizes


def test_op13(spark, data):  # noqa: F811
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    loads, sizes = check_shards(__spark_entry__.queries()["op13_sharding"](spark, data).collect(), docs, 16)
    plain = brute.longest_first(sizes.values(), 16)
    assert max(loads) - min(loads) <= max(plain) - min(plain) + max(sizes.values()) // 1000


def test_sharding_is_longest_first(spark, monkeypatch):
    r = random.Random(9)
    docs = [(i, r.choice("abcé") * r.randint(0, 400)) for i in range(3000)] + [(None, None), (None, None), (1, "")] + [(7, "same")] * 50
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, shard string")
    out = sharding.place_documents(df.repartition(5), 5).collect()
    loads, sizes = check_shards(out, docs, 5)
    assert loads == brute.longest_first(sizes.values(), 5)
    monkeypatch.setattr(sharding, "COPIES", 8)
    monkeypatch.setattr(numbering, "PART", 100)
    again = sharding.place_documents(df, 5).collect()
    assert check_shards(again, docs, 5)[0] == loads
    kept = sharding.add_shard(df, 5, "at")
    assert kept.columns == [*df.columns, "at"] and kept.count() == len(docs)
    # large groups share runs
    docs = [(i, "x" * (20_000 + 7 * i)) for i in range(90)] + [(i, "y" * (i % 90)) for i in range(200)]
    loads, sizes = check_shards(sharding.place_documents(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect(), docs, 4)
    assert max(loads) <= max(brute.longest_first(sizes.values(), 4)) + 900
