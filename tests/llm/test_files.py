"""Token files and archives under odd ids: rows are spread whatever the ids are."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chatloom.llm import token_blocks, warc

N = 4000


def ids_of(kind):
    """Dense ids; dense ids and one far away; a third without an id; a third with one id."""
    far = F.when(F.col("id") == N - 1, F.lit(2**62)).otherwise(F.col("id"))
    return {
        "dense": F.col("id"),
        "outlier": far,
        "null": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long"),
        "repeated": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long"),
    }[kind]


def by_word(texts):
    return [np.array([len(w) for w in t.split()], np.uint32) for t in texts]


@pytest.mark.parametrize("kind", ["dense", "outlier", "null", "repeated"])
def test_files_are_spread(spark, tmp_path, kind):
    docs = spark.range(N).select(ids_of(kind).alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int")), F.lit("x"), F.col("id").cast("string")).alias("text"))
    m = token_blocks.write_tokens(docs, f"file://{tmp_path}/{kind}", lambda: by_word, 2, file_docs=300)
    files = m.orderBy("part", "roll").collect()
    per_part = {}
    for f in files:
        per_part[f.part] = per_part.get(f.part, 0) + f.n_docs
    assert sum(per_part.values()) == N and max(per_part.values()) < 2 * N / 4 and max(f.n_docs for f in files) <= 300
    assert [f.start for f in files] == np.cumsum([0, *(f.n_ids for f in files)])[:-1].tolist()
    got = {}
    for r in token_blocks.read_tokens(m).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.append(by_word([r.text])[0], 2).astype("<u4").tobytes())
    assert {k: sorted(x for _, x in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted((s, k is not None, k or 0) for k, v in got.items() for s, _ in v)
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)


@pytest.mark.parametrize("kind", ["outlier", "null", "repeated"])
def test_archives_are_spread(spark, tmp_path, kind):
    pages = spark.range(N).select(ids_of(kind).alias("page_id"), F.lit("http://a/b").alias("url"), F.concat(F.lit("<p>"), (F.col("id") % 1000).cast("string")).alias("html"))
    m = warc.write_archives(pages, f"file://{tmp_path}/{kind}", file_bytes=50_000)
    records = [r.records for r in m.collect()]
    assert sum(records) == N and max(records) < N / 4
    out = warc.read_archives(m).collect()
    assert len(out) == N
    last = {r.html: r.last for r in pages.groupBy("html").agg(F.max("page_id").alias("last")).collect()}
    assert all(r.html is None or r.page_id == last[r.html] for r in out)
    assert all(r.record_type == "revisit" for r in out if r.page_id is None)


def test_long_document(spark, tmp_path):
    """One document over many blocks, with outliers, next to empty ones."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 100, 300_000).astype(np.uint32)
    ids[::997] = 2**31
    docs = spark.createDataFrame([(1, ""), (2, "long"), (3, None)], "doc_id long, text string")
    m = token_blocks.write_tokens(docs, f"file://{tmp_path}/long", lambda: lambda texts: [ids if t == "long" else ids[:0] for t in texts], 9)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in token_blocks.read_tokens(m).collect()}
    assert (got[2] == np.append(ids, 9)).all() and got[1].tolist() == got[3].tolist() == [9]


@pytest.mark.parametrize("kind", ["dense", "null", "repeated"])
def test_two_writes_are_alike(spark, tmp_path, kind):
    """Archives and token files of the same rows, however these are dealt, have the same names, counts and bytes."""
    pages = spark.range(60_000 if kind == "dense" else N).select(ids_of(kind).alias("page_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("body "), (F.col("id") % 1000).cast("string")).alias("html"))
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    seen = []
    for i, n in enumerate((3, 7)):
        m = warc.write_archives(pages.repartition(n), f"file://{tmp_path}/{kind}{i}", file_bytes=50_000).collect()
        t = token_blocks.write_tokens(docs.repartition(n), f"file://{tmp_path}/{kind}t{i}", lambda: by_word, 2, file_docs=3000).collect()
        files = [(r.path.rsplit("/", 1)[1], (tmp_path / f"{kind}t{i}" / r.path.rsplit("/", 1)[1]).read_bytes()) for r in t]
        seen.append((sorted((r.path.rsplit("/", 1)[1], r.records, r.bytes, r.crc32) for r in m), sorted(files)))
    assert seen[0] == seen[1] and len(seen[0][0]) > 3


def test_chunks_are_learned_when_looked_up():
    """One look-up a chunk, known or not, gives what the library gives; long chunks are not kept."""
    path = public_tokenizers.path("word_bpe_49k.json")
    quick, exact = token_blocks.ChunkTokenizer(path), token_blocks.ChunkTokenizer(path, exact=True)
    chunks = ["", "Word,", "word", "WORD!?", "don't", "Ⱥb", "été.", "東京タワー", "<|x|>", "a1b2", "...", "ſ", "x" * 200 + ".", "İ,"]
    for c in chunks * 2:
        assert np.frombuffer(quick.known[c], np.uint32).tolist() == exact.encode([c])[0].tolist()
    assert "Word," in quick.known and max(map(len, quick.known)) <= quick.LONG and max(map(len, quick.pieces)) <= quick.LONG
    texts = [" ".join(chunks), "Word,\nword\tWORD!?  ", ""]
    assert [x.tolist() for x in quick.encode(texts)] == [x.tolist() for x in exact.encode(texts)]


@pytest.mark.parametrize("width", [0, 1, 7, 8, 15, 16, 31, 32])
def test_packed_bits(width):
    values = np.random.default_rng(width).integers(0, 1 << 32, 777, dtype=np.uint64).astype(np.uint32)
    low = values & np.uint32((1 << width) - 1)
    raw = token_blocks.pack(values, width)
    assert int.from_bytes(raw, "little") == sum(int(v) << (i * width) for i, v in enumerate(low))
    assert token_blocks.unpack(raw, len(values), width).tolist() == low.tolist()
