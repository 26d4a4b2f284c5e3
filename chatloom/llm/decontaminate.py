"""Benchmark decontamination: which document words lie in a passage of a benchmark item.

A prefix-filtered set join at containment 1. An item's windows (13 words in a row, or the whole
shorter item) are sets of three-word shingles; the shingles are ordered by how rarely they occur
in the documents, and since a window must be contained whole, the rarest shingle alone is the
necessary prefix. Documents look their shingles up among those anchors; a match gives the
window's start, which must fit in the document (position and length bounds), and the window is
then compared word for word over its own length.

Defined results: null text and text without words has no words and is never contaminated. Items
without words have no windows; a null item id counts as the text `null`. Repeated documents are
judged alike; items that repeat an id count once. Words are compared as 64-bit hashes. A very long
text is hashed in pieces and matched whole. Without documents there are no rows, without items
no hits. `drop_contaminated` keeps all columns, `find_passages` the id only, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, tidy
from .words import ALNUM_WORDS, slices, text_buffers, window_hashes, word_hashes

WINDOW, SHINGLE = 13, 3
#: Benchmark windows that go to the executors at once; a larger benchmark takes several passes.
WINDOWS_AT_ONCE = 200_000


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, words array<bigint>): the distinct windows of each item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffers(b.column(1))
            for i, item in enumerate(b.column(0).to_pylist()):
                h, _ = word_hashes(buf, offsets[i : i + 2], ALNUM_WORDS)
                if len(h):
                    k = min(WINDOW, len(h))
                    w = np.unique(np.lib.stride_tricks.sliding_window_view(h, k), axis=0).view(np.int64)
                    for at in range(0, len(w), 10_000):
                        part = w[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part)), pa.array(part.tolist(), pa.list_(pa.int64()))], ["item", "words"])

    return rows.mapInArrow(tidy(run), "item string, words array<bigint>").distinct()


class Windows:
    """A block of windows, indexed by their anchors."""

    def __init__(self, items: list[str], words: list[list[int]]):
        self.items = np.array(items, object)
        self.names = sorted(set(items))
        number = {x: i for i, x in enumerate(self.names)}
        self.item_of = np.array([number[x] for x in items], np.int64)
        self.words = [np.array(w, np.int64).view(np.uint64) for w in words]
        self.lengths = np.array([len(w) for w in words], np.int64)
        # every shingle of every window, for counting; shingles of short windows are the windows
        self.size = np.minimum(SHINGLE, self.lengths)
        rows = [window_hashes(w, int(k)) for w, k in zip(self.words, self.size, strict=True)]
        self.shingles = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.uint64)
        self.rows = rows

    def count(self, h: np.ndarray, woffs: np.ndarray) -> np.ndarray:
        """How often each shingle occurs in the texts."""
        out = np.zeros(len(self.shingles), np.int64)
        for k in np.unique(self.size):
            at = self._at(window_hashes(h, int(k)), self.shingles)[1]
            out += np.bincount(at, minlength=len(out))
        return out

    @staticmethod
    def _at(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indices in known) of the hashes that are in the sorted array."""
        if not len(known) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.uint64(0xFFFFF)
        seen = np.zeros(1 << 20, bool)
        seen[known & low] = True
        pos = np.flatnonzero(seen[hashes & low])
        i = np.minimum(np.searchsorted(known, hashes[pos]), len(known) - 1)
        ok = known[i] == hashes[pos]
        return pos[ok], i[ok]

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle and post the window under it."""
        self.plans = []
        rank = np.lexsort((self.shingles, counts)).argsort()
        anchor, offset = [], []
        for row in self.rows:
            r = rank[np.searchsorted(self.shingles, row)]
            offset.append(int(r.argmin()))
            anchor.append(row[offset[-1]])
        anchor, offset = np.array(anchor, np.uint64), np.array(offset, np.int64)
        for length in np.unique(self.lengths):
            w = np.flatnonzero(self.lengths == length)
            w = w[np.argsort(anchor[w], kind="stable")]
            keys, first, n = np.unique(anchor[w], return_index=True, return_counts=True)
            self.plans.append((int(length), keys, first, n, offset[w], self.item_of[w], np.array([self.words[i] for i in w])))

    def find(self, h: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is hit, text numbers, item numbers): the pairs are distinct."""
        cover = np.zeros(len(h) + 1, np.int64)
        docs, items = [], []
        grams: dict[int, np.ndarray] = {}
        for length, keys, first, count, offset, item, words in self.plans:
            k = min(SHINGLE, length)
            if k not in grams:
                grams[k] = window_hashes(h, k)
            pos, key = self._at(grams[k], keys)
            if not len(pos):
                continue
            c = count[key]
            w = np.repeat(first[key], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            doc = np.searchsorted(woffs, np.repeat(pos, c), "right") - 1
            start = np.repeat(pos, c) - offset[w]
            fits = (start >= woffs[doc]) & (start + length <= woffs[doc + 1])
            w, doc, start = w[fits], doc[fits], start[fits]
            same = (h[start[:, None] + np.arange(length)] == words[w]).all(1)
            w, doc, start = w[same], doc[same], start[same]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            docs.append(doc)
            items.append(item[w])
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], 1), axis=0) if docs else np.zeros((0, 2), np.int64)
        return np.cumsum(cover[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def _texts(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = text_buffers(col)
    for i, j in slices(offsets):
        yield i, j, *word_hashes(buf, offsets[i : j + 1], ALNUM_WORDS)


def _prepared(docs: DataFrame, text_col: str, block: list) -> Windows:
    """The block's windows, posted under the shingles that are rarest in all documents."""
    windows = Windows([r["item"] for r in block], [r.words for r in block])
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.shingles), np.int64)
        for b in batches:
            for _, _, h, woffs in _texts(b.column(0)):
                total += shared.value.count(h, woffs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["i", "n"])

    counts = np.zeros(len(windows.shingles), np.int64)
    for r in docs.select(text_col).mapInArrow(tidy(run), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r.i] = r.n
    windows.order(counts)
    return windows


def _blocks(windows: DataFrame) -> Iterator[list]:
    """The windows in lists of about WINDOWS_AT_ONCE, whole items together or not."""
    windows = materialise(windows, "benchmark-windows")
    parts = max(1, -(-windows.count() // WINDOWS_AT_ONCE))
    for i in range(parts):
        yield windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == i).sort("item", "words").collect()


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items array<string>) per row of docs.

    One pass over the texts for rarity and one for matching, for each block of windows. Blocks after
    the first give the texts that they hit only, by digest; their covered words are united.
    """
    blocks = _blocks(benchmark_windows(items))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    out = _matched(rows, _prepared(docs, text_col, next(blocks)))
    more = [_hits(docs, text_col, block) for block in blocks]
    if more:
        also = _by_text(more).select("key", F.col("runs").alias("more_runs"), F.col("items").alias("more_items"))
        out = materialise(out, "passages").join(also, "key", "left")
        none = F.array()
        out = out.withColumns({"runs": F.concat("runs", F.coalesce("more_runs", none)), "items": F.concat("items", F.coalesce("more_items", none))})
    return out.select(F.col("id").alias(id_col), "n_words", _covered("runs").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))


def _hits(docs: DataFrame, text_col: str, block: list) -> DataFrame:
    """(key, n_words, runs, items) of the different texts that a block of windows hits."""
    rows = docs.select(F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found = _matched(rows, _prepared(docs, text_col, block)).where(F.size("runs") > 0)
    return materialise(found.dropDuplicates(["key"]), "block-hits")


def _by_text(hits: list[DataFrame]) -> DataFrame:
    """(key, n_words, runs, items) of each text over all blocks; a text has at most one row of each block."""
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return every.groupBy("key").agg(F.first("n_words").alias("n_words"), flat("runs"), flat("items"))


def _covered(runs: str):
    """Words in the union of the runs: sorted by start, each adds what lies beyond the furthest end so far."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("far"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(zero, r["e"] - F.greatest(r["s"], a["far"]))).alias("n"), F.greatest(a["far"], r["e"]).alias("far"))
    return F.aggregate(F.array_sort(runs), start, step, lambda a: a["n"])


_RUNS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _matched(rows: DataFrame, windows: Windows) -> DataFrame:
    """rows (..., text) without the text but with n_words, runs of covered words and items."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            runs, items = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for i, j, h, woffs in _texts(b.column(len(kept))):
                n_words[i:j] = np.diff(woffs)
                hit, doc, item = shared.value.find(h, woffs)
                for d, it in zip(doc, item, strict=True):
                    items[i + d].append(shared.value.names[it])
                for d in np.unique(doc):
                    runs[i + d] += _runs_of(hit[woffs[d] : woffs[d + 1]])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n_words), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))], [*b.schema.names[: len(kept)], "n_words", "runs", "items"])

    run_ = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_)), T.StructField("items", T.ArrayType(T.StringType()))]
    return rows.select(*(f.name for f in kept), "text").mapInArrow(tidy(run), T.StructType([*kept, *added]))


def _runs_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    return [dict(s=int(s), e=int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def passage_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_hit, n_items, digest of the items and the contamination rule per document."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def is_contaminated():
    """A hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; columns stay.

    One block of windows is judged in the pass that filters. Several are matched one after the other,
    so what is broadcast stays within WINDOWS_AT_ONCE, and the texts found are joined by digest.
    """
    blocks = _blocks(benchmark_windows(items))
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        hits = [_hits(docs, text_col, block) for block in (first, second, *blocks)]
        bad = _by_text(hits).withColumn("n_hit", _covered("runs")).where(is_contaminated()).select(F.col("key").alias("dec__key"))
        return docs.join(materialise(bad, "contaminated-texts"), F.md5(docs[text_col]) == F.col("dec__key"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_prepared(docs, text_col, first))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, h, woffs in _texts(b.column(at)):
                n_hit = np.diff(np.concatenate([[0], np.cumsum(shared.value.find(h, woffs)[0])])[woffs])
                keep[i:j] = (n_hit == 0) | (20 * n_hit < np.diff(woffs))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
