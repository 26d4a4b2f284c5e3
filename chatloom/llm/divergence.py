"""Source divergence audit: how far apart do the sources of a language write?

Each language keeps the terms that occur in enough of its documents. A source's term has a smoothed
share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), where N is the source's count of kept terms and V their
number. Two sources are as far apart as their shares of all kept terms differ in sum.

That sum runs over all terms for every pair of sources, though most sources lack most terms. So it is taken as
V |b - b'| (b: the share of a term that a source lacks), plus corrections of single sources for their
nonzero counts, plus corrections of pairs for terms that both have. The last come from a frequent-
pattern tree: a term's row is the list of its nonzero counts in the order of sources, equal rows count with
their multiplicity, and rows are inserted in sorted order, so that those with the same beginning share a path.
Each combination of a node with one of its ancestors is one pair of sources with two counts; its correction is
computed once and counts as often as terms pass through the node. Spark range-partitions the rows by
language and row; a task builds the tree over blocks of its sorted rows and gives sums by pair of sources.

Null text, lang and source count as empty. Documents without words still make their source known. A
language without kept terms has pairs of value 0 and no terms. Repeated rows count as often as they
occur; ids play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, tidy

#: Bytes of text that are taken apart at once.
SLICE = 1 << 22
#: Counts that a task keeps before it hands them on.
KEEP = 200_000
#: Counts of a block of rows; also combinations of nodes and ancestors that are made at once.
BLOCK = 1 << 19
#: Smoothing: what is added to each count, and the number that shares sum to.
ADDED, SCALE = 5, 1_000_000_000

_WORDS = re.compile(rb"[a-z\x80-\xff]+").findall
_GAP = re.compile(rb"[^a-z\x80-\xff]")

COUNTS = "lang string, source string, term string, n long, docs long"


def _slices(text: bytes) -> Iterator[bytes]:
    """Text in slices that do not cut a word (unless there is no gap at all)."""
    at = 0
    while len(text) - at > SLICE:
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    kept = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            if (lang, source) not in counts:
                counts[lang, source] = Counter(), Counter()
            n, docs = counts[lang, source]
            before, seen = len(n), set()
            for part in _slices(text.as_buffer().to_pybytes().lower()):  # of bytes, only A-Z
                words = _WORDS(part)
                n.update(words)
                seen.update(words)
            docs.update(seen)
            kept += len(n) - before
            if kept > KEEP:
                yield from emit()
                kept = 0
    yield from emit()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each source, each combination once."""
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = plain.mapInArrow(tidy(_count_terms), COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (count + 5) / total) in exact numbers."""
    return f"1 + ((cast({count} as decimal(20,0)) + {ADDED}) * cast({SCALE} as decimal(10,0))) div {total}"


def _tree_pairs(g: np.ndarray, p: np.ndarray, b: np.ndarray, offs: np.ndarray, mult: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, later source, correction) sums over the tree of sorted rows; row i has the items offs[i] to offs[i + 1]."""
    sizes = np.diff(offs)
    depth = np.arange(len(g)) - np.repeat(offs[:-1], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # what a row shares with the one before it
    above = np.repeat(np.concatenate([[0], offs[:-2]]), sizes) + depth
    has = depth < np.repeat(np.concatenate([[0], sizes[:-1]]), sizes)
    above[~has] = 0
    new = ~(has & (g == g[above]) & (p == p[above]))
    shared = np.minimum.reduceat(np.where(new, depth, np.iinfo(np.int64).max), offs[:-1])
    shared = np.minimum(shared, sizes)
    # nodes: the items from there on; terms pass through a node until a row shares less
    passing = np.zeros(len(g), np.int64)
    for d in range(int(sizes.max())):
        begins = np.flatnonzero(shared <= d)
        sums = np.add.reduceat(mult, begins)
        own = sizes[begins] > d
        passing[offs[begins[own]] + d] = sums[own]
    nodes = np.flatnonzero((depth >= shared[row]) & (depth > 0))
    ends = np.cumsum(depth[nodes])
    at = 0
    while at < len(nodes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        some = nodes[at:to]
        node = np.repeat(some, depth[some])
        first = np.repeat(ends[at:to] - depth[some] - base, depth[some])
        anc = offs[row[node]] + np.arange(len(node)) - first
        own, other, own_b, other_b = p[node], p[anc], b[node], b[anc]
        value = np.abs(own - other) - np.abs(own - other_b) - np.abs(other - own_b) + np.abs(own_b - other_b)
        key = g[anc] << 32 | g[node]
        order = np.argsort(key, kind="stable")
        key, value = key[order], (value * passing[node])[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[begin] >> 32, key[begin] & 0xFFFFFFFF, np.add.reduceat(value, begin)
        at = to


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of rows (lang, g, p, b lists, mult) that come sorted by lang and row."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        lists, mult = [batch.column(i) for i in (1, 2, 3)], batch.column(4).to_numpy()
        offs = lists[0].offsets.to_numpy().astype(np.int64)
        flat = [x.values.to_numpy()[offs[0] : offs[-1]].astype(np.int64) for x in lists]
        offs -= offs[0]
        at = 0
        while at < len(langs):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK, "right")) - 1)
            while langs[to - 1] != langs[at]:  # one language a tree
                to = at + 1 + (to - 1 - at) // 2
            low, high = offs[at], offs[to]
            for a, c, v in _tree_pairs(*(x[low:high] for x in flat), offs[at : to + 1] - low, mult[at:to]):
                yield pa.RecordBatch.from_arrays([pa.array([langs[at]] * len(a)), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.int64())], ["lang", "low", "high", "value"])
            at = to


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """Pairs and marked terms of the sources of docs (lang, source, text): lang, source, part, item, value, rank.

    Part `pair` has each other source of the language, farthest first. Part `term` has the source's terms
    with a larger share than in the whole language, by how much, up to rank top_terms.
    """
    counts = term_counts(docs)
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    terms = materialise(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    cells = terms.select("lang", "term", "total", F.inline("row"))

    known = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    per_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = known.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.withColumns({"size": F.coalesce("source_n", F.lit(0)) + ADDED * F.col("v"), "lang_size": F.col("lang_n") + ADDED * F.col("v")})
    in_order = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = materialise(groups.select("lang", "source", in_order.cast("long").alias("g"), "v", "size", "lang_size", F.expr(_share("0", "size")).alias("b")), "sources")

    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", "g", "b", F.expr(_share("n", "size")).alias("p"), F.expr(_share("total", "lang_size")).alias("q"))
    shares = materialise(shares, "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marked = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "b"))).alias("row"))
    rows = rows.groupBy("lang", "row").agg(F.count("*").alias("mult"))
    # ranges by a row's beginning, so that Spark's sample of the keys stays small; equal beginnings are spread by a hash
    begin = F.transform(F.slice("row", 1, 3), lambda x: x["p"])
    ordered = rows.repartitionByRange("lang", begin, F.xxhash64("row")).sortWithinPartitions("lang", "row")
    both = ordered.select("lang", "row.g", "row.p", "row.b", "mult").mapInArrow(tidy(_corrections), "lang string, low long, high long, value long")

    name = groups.select("lang", "source", "g", "b", "v")
    other = name.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("b").alias("c"))
    low_high = [F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high")]
    base = name.join(other, "lang").where("g < h").select("lang", *low_high, F.coalesce(F.col("v") * F.abs(F.col("b") - F.col("c")), F.lit(0)).alias("value"))
    single = shares.groupBy("lang", "g", "b", "p").agg(F.count("*").alias("mult")).join(other, "lang").where("g <> h")
    single = single.select("lang", *low_high, (F.col("mult") * (F.abs(F.col("p") - F.col("c")) - F.abs(F.col("b") - F.col("c")))).alias("value"))
    sums = base.union(single).union(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("low").alias("g"), F.col("high").alias("h")), F.struct(F.col("high").alias("g"), F.col("low").alias("h")))).alias("way"))
    ways = ways.select("lang", "value", "way.g", "way.h")
    pairs = ways.join(name.select("lang", "source", "g"), ["lang", "g"]).join(other.select("lang", "item", "h"), ["lang", "h"])
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(best).alias("rank"))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(marked.withColumn("part", F.lit("term")).select(columns))
