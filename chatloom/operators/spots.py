"""The best texts of each full-text query, block against block.

A block of texts is indexed once by term, text and position. Queries of one shape (the same parts over other words) are
worked out together: the texts with the rarest word of a part are candidates, the other words are looked up for these
alone. A task keeps each query's first rows over all of its blocks; texts whose number of spots cannot reach the last of
them are left out. What leaves a task is `limit` rows a query, whatever the number of matches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import stored
from .blocks import against, query_blocks, tidy

#: Tokens and texts that end a corpus block, queries of a block, queries whose first rows a task keeps.
TOKENS, TEXTS, QUERIES, PART = 1 << 20, 1 << 15, 8192, 1 << 17
#: Words of candidates that are looked up at once, and rows that wait to be ranked.
CANDIDATES, WAITING = 1 << 19, 1 << 16
#: A task's first block is small, as nothing is known yet that could leave texts out; each next one may be four times as large.
FIRST = 1 << 10
#: Share of a stretch whose words have nothing between them, and digits of a rank.
WEIGHT, DIGITS = 0.1, 9

BLOCKS = "ids array<long>, news array<long>, sizes array<int>, codes array<int>, terms array<string>"
_HITS = "query_id long, id long, newer long, rank double"


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, newer, tokens) in blocks, tokens as numbers into the block's terms."""
    parts, texts, size, most = [], 0, 0, min(FIRST, TEXTS)

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, news = (table.column(i).to_numpy() for i in range(2))
        tokens = table.column(2).combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        coded = tokens.flatten().dictionary_encode()
        columns = [(ids, pa.int64()), (news, pa.int64()), (pc.list_value_length(tokens).to_numpy(zero_copy_only=False), pa.int32()), (coded.indices.to_numpy(), pa.int32()), (coded.dictionary, pa.string())]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in columns], ["ids", "news", "sizes", "codes", "terms"])

    for whole in batches:
        at = 0
        while at < whole.num_rows:
            batch = whole.slice(at, most - texts)
            at += batch.num_rows
            parts.append(batch)
            texts, size = texts + batch.num_rows, size + len(batch.column(2).flatten())
            if texts >= most or size >= TOKENS:
                yield block()
                parts, texts, size, most = [], 0, 0, min(most * 4, TEXTS)
    if parts:
        yield block()


class Index:
    """A block's postings: a run of positions for each term and text, in order."""

    def __init__(self, ids: np.ndarray, news: np.ndarray, sizes: np.ndarray, codes: np.ndarray, terms: pa.Array):
        self.ids, self.news, self.terms, self.n = ids, news, terms, max(len(ids), 1)
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(sizes)
        self.pos = (np.arange(1, len(codes) + 1) - np.repeat(ends - sizes, sizes))[order]
        key = codes[order].astype(np.int64) * self.n + np.repeat(np.arange(len(sizes)), sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.key, self.start = key[first], np.append(first, len(key))
        self.term = np.searchsorted(self.key, np.arange(len(terms) + 1, dtype=np.int64) * self.n)
        self.wide = int(sizes.max() if len(sizes) else 0)

    def count_often(self) -> None:
        """What often, newest and before need: the texts are in order, newest first; postings of terms that a text repeats, by term, the most frequent first."""
        times = np.diff(self.start)
        self.most = int(times.max() if len(times) else 0) + 1
        again = np.flatnonzero(times > 1)
        key = self.key[again] // self.n * (self.most + 1) + self.most - times[again]
        order = np.argsort(key, kind="stable")
        self.frequent, self.frequent_key = again[order], key[order]
        self.frequent_term = np.searchsorted(self.frequent_key, np.arange(len(self.terms) + 1) * (self.most + 1))

    def often(self, code: np.ndarray, times: np.ndarray) -> np.ndarray:
        """In how many texts each term is at least so often, for two times or more."""
        least = self.most - np.minimum(times, self.most)
        return np.where(code >= 0, np.searchsorted(self.frequent_key, code * (self.most + 1) + least, "right") - self.frequent_term[code], 0)

    def newest(self, news: np.ndarray) -> np.ndarray:
        """How many texts are not older."""
        return len(self.news) - np.searchsorted(self.news[::-1], news)

    def before(self, code: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """In how many of the first texts each term is."""
        return np.where(code >= 0, np.searchsorted(self.key, code * self.n + texts) - self.term[code], 0)

    def texts(self, code: np.ndarray) -> np.ndarray:
        """In how many texts each term is, 0 for a missing one."""
        return np.where(code >= 0, self.term[code + 1] - self.term[code], 0)


def runs(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the elements of the runs begin[i], begin[i] + 1, ... of n[i] elements."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begin[owner]


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """x >= 0 to that many places, halves of its shortest decimal form up, as SQL rounds."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    if len(near):
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values])[at]
    return out


def cover_density(owner: np.ndarray, pos: np.ndarray, slot: np.ndarray, n: int, parts: list[list[list[int]]]) -> np.ndarray:
    """Ranks of n texts by their spots in order; see search for the definition."""
    first = np.searchsorted(owner, np.arange(n))
    if len(parts) == 1 and all(len(alt) == 1 for alt in parts[0]):  # each spot is a stretch
        near = np.zeros(n)
        if len(owner) > 1:
            same = owner[1:] == owner[:-1]
            near = np.bincount(owner[1:][same], 1.0 / (pos[1:] - pos[:-1])[same], n)
        return np.where(near > 0, WEIGHT * near, WEIGHT)
    at = np.arange(len(owner))
    start = first[owner]
    last = {s: np.maximum.accumulate(np.where(slot == s, at, -1)) for s in {s for part in parts for alt in part for s in alt}}
    last = {s: np.where(x >= start, x, -1) for s, x in last.items()}  # -1: not yet in this text
    places = [np.max([np.min([last[s] for s in alt], axis=0) for alt in part], axis=0) for part in parts]
    begin = np.min(places, axis=0)
    before = np.concatenate([[-1], begin[:-1]])
    before[start == at] = -1
    new = np.flatnonzero(begin > before)
    o, b = owner[new], begin[new]
    between = np.maximum((pos[new] - pos[b]) - (new - b), 0)
    middle = (pos[b] + pos[new]) / 2
    total, count, near = np.bincount(o, WEIGHT / (1 + between), n), np.bincount(o, minlength=n), np.zeros(n)
    if len(o) > 1:
        gap = middle[1:] - middle[:-1]
        ok = (o[1:] == o[:-1]) & (gap > 0)
        near = np.bincount(o[1:][ok], 1.0 / gap[ok], n)
    return np.where(near > 0, total / (count / np.where(near > 0, near, 1.0)), total)


class Best:
    """Each query's first rows so far: rank, then newest, then smaller id; rank and news may begin at those of `limit` rows that are known elsewhere."""

    def __init__(self, queries: int, limit: int, rank: np.ndarray | None = None, news: np.ndarray | None = None):
        self.queries, self.limit = queries, limit
        self.rows = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.rank = np.full(queries, -np.inf) if rank is None else rank.copy()
        self.news = np.full(queries, np.iinfo(np.int64).min) if news is None else news.copy()

    def can_enter(self, query: np.ndarray, most: np.ndarray, news: np.ndarray) -> np.ndarray:
        """Whether rows of at most that rank can still be among the first."""
        least = self.rank[query]
        return (most > least + 1e-9) | ((most >= least - 1e-9) & (news >= self.news[query]))

    def add(self, *found: tuple[np.ndarray, ...]) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, *found, strict=True)]
        query, rank, news, ids = rows
        order = np.lexsort((ids, ~news, -rank, query))
        nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        self.rows = tuple(x[order[nth < self.limit]] for x in rows)
        last = order[nth == self.limit - 1]
        self.rank[query[last]], self.news[query[last]] = rank[last], news[last]


def _chunks(cost: np.ndarray, most: int) -> Iterator[slice]:
    at, total = 0, np.cumsum(cost)
    while at < len(cost):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _fewest(parts: list[list[list[int]]]) -> int:
    """How many spots of a text are not an end of a stretch or the first one: a stretch needs one of each part."""
    own = [{s for alt in part for s in alt} for part in parts]
    return len(own) if sum(map(len, own)) == len(set().union(*own)) else 1


def _sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x, kind="stable")  # a few runs in order
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _matches(index: Index, codes: np.ndarray, query: np.ndarray, shape: dict, best: Best) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, rank, newer, id) of texts that match queries of one shape; codes: the block's number of each query's terms, -1 for none.

    A rank is at most WEIGHT times the number of spots. Where the first rows so far have as much, texts with few spots must be
    newer than the last of them, and others must have a word often; both are runs of postings.
    """
    parts, nevers, wanted = shape["parts"], shape["nevers"], shape["wanted"]
    df = index.texts(codes)
    rarest = [[np.array(alt)[np.argmin(df[:, alt], axis=1)] for alt in part] for part in parts]
    each = np.arange(len(codes))
    cost = np.stack([sum(df[each, s] for s in part) for part in rarest], axis=1)
    alive = (cost > 0).all(axis=1)
    part_of = np.argmin(cost, axis=1)
    least = np.maximum(best.rank[query], 0) + 1e-9
    often = -(-np.where(least >= WEIGHT, np.floor(least / WEIGHT + _fewest(parts)) + 1, 1).astype(np.int64) // wanted)
    many = np.stack([index.often(codes[:, s], often) for s in range(wanted)], axis=1)
    newest = index.newest(best.news[query])
    begin = lambda code: np.where(code >= 0, index.term[code], 0)
    for p, part in enumerate(rarest):
        rows = np.flatnonzero(alive & (part_of == p))
        new = [index.before(codes[rows, s[rows]], newest[rows]) for s in part]
        few = sum(new) + many[rows].sum(axis=1)
        narrow = (often[rows] > 1) & (few < cost[rows, p])
        for some in (False, True):
            at = np.flatnonzero(narrow == some)
            for chunk in _chunks((few[at] if some else cost[rows[at], p]), CANDIDATES // codes.shape[1]):
                own = at[chunk]
                mine = rows[own]
                found = []
                for k, s in enumerate(part):
                    code = codes[mine, s[mine]]
                    owner, place = runs(begin(code), new[k][own] if some else df[mine, s[mine]])
                    found.append(owner * index.n + index.key[place] % index.n)
                for s in range(wanted if some else 0):
                    code = codes[mine, s]
                    owner, place = runs(np.where(code >= 0, index.frequent_term[code], 0), many[mine, s])
                    found.append(owner * index.n + index.key[index.frequent[place]] % index.n)
                cand = found[0] if len(found) == 1 else _sorted_unique(np.concatenate(found))
                if len(cand):
                    yield from _worked_out(index, codes[mine], query[mine], cand, parts, nevers, wanted, best)


def _worked_out(index: Index, codes: np.ndarray, query: np.ndarray, cand: np.ndarray, parts: list, nevers: list, wanted: int, best: Best) -> Iterator[tuple[np.ndarray, ...]]:
    row, text = cand // index.n, cand % index.n
    need = sorted({s for part in parts for alt in part for s in alt} | {s for alt in nevers for s in alt})
    place, have = {}, {}
    for s in need:
        code = codes[row, s]
        place[s] = np.minimum(np.searchsorted(index.key, code.astype(np.int64) * index.n + text), len(index.key) - 1)
        have[s] = (code >= 0) & (index.key[place[s]] == code.astype(np.int64) * index.n + text)
    all_of = lambda alt: np.all([have[s] for s in alt], axis=0)
    ok = np.all([np.any([all_of(alt) for alt in part], axis=0) for part in parts], axis=0)
    for alt in nevers:
        if len(alt) == 1:
            ok &= ~have[alt[0]]
    size = {s: np.where(have[s], index.start[place[s] + 1] - index.start[place[s]], 0) for s in need}
    # stretches begin and end at different spots and their middles are at least 1 apart, so this is the most that a rank can be
    most = WEIGHT * np.maximum(sum(size[s] for s in need if s < wanted) - _fewest(parts), 1)
    ok &= best.can_enter(query[row], most, index.news[text])
    kept = np.flatnonzero(ok)
    if not len(kept):
        return
    spots = []
    for s in need:
        owner, at = runs(index.start[place[s][kept]], size[s][kept])
        spots.append((owner, index.pos[at], np.full(len(owner), s)))
    owner, pos, slot = (np.concatenate(x) for x in zip(*spots, strict=True))
    wide = index.wide + 2 + max(len(alt) for alt in [a for part in parts for a in part] + nevers)
    key = owner * wide + pos
    if len(need) > 1:
        order = np.argsort(key, kind="stable")
        owner, pos, slot, key = owner[order], pos[order], slot[order], key[order]
    at_slot = {s: key[slot == s] for s in need}

    def follow(alt: list[int]) -> np.ndarray:
        if len(alt) == 1:
            return have[alt[0]][kept]
        begin = at_slot[alt[0]]
        for k, s in enumerate(alt[1:], 1):
            begin = begin[_has(at_slot[s], begin + k)]
        out = np.zeros(len(kept), bool)
        out[begin // wide] = True
        return out

    good = np.all([np.any([follow(alt) for alt in part], axis=0) for part in parts], axis=0)
    for alt in nevers:
        good &= ~follow(alt)
    number = np.cumsum(good) - 1
    use = good[owner] & (slot < wanted)
    rank = rounded(cover_density(number[owner[use]], pos[use], slot[use], int(good.sum()), parts))
    q, t = query[row[kept[good]]], text[kept[good]]
    enter = best.can_enter(q, rank, index.news[t])
    yield q[enter], rank[enter], index.news[t[enter]], index.ids[t[enter]]


class _Asked:
    """A query block: ids, different terms, the queries by shape, and their first rows so far."""

    def __init__(self, rows: pa.StructArray, limit: int):
        self.ids, shapes, terms = rows.field("query_id").to_numpy(), rows.field("shape").to_pylist(), rows.field("terms")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
        coded = terms.flatten().dictionary_encode()
        codes, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        by_shape: dict[str, list[int]] = {}
        for i, s in enumerate(shapes):
            by_shape.setdefault(s, []).append(i)
        self.shape, self.row, self.shapes = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), []
        owner, must = [], []
        for n, (text, own) in enumerate(by_shape.items()):
            shape, own = json.loads(text), np.array(own)
            mine = codes[ends[own][:, None] + np.arange(shape["terms"])]
            self.shape[own], self.row[own] = n, np.arange(len(own))
            self.shapes.append((shape, own, mine))
            # words that a text must have: those of parts without another choice
            slots = sorted({s for part in shape["parts"] if len(part) == 1 for s in part[0]})
            owner.append(np.repeat(own, len(slots)))
            must.append(mine[:, slots].ravel())
        self.owner, self.must = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owner, must))
        first = rows.field("floor"), rows.field("floor_newer")
        self.best = Best(len(self.ids), limit, first[0].fill_null(-np.inf).to_numpy(zero_copy_only=False), first[1].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
        self.waiting, self.n = [], 0

    def meet(self, index: Index) -> None:
        """Keep what the index's texts have for the queries; a query of which a word is missing costs nothing more."""
        code = pc.index_in(self.terms, value_set=index.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        alive = np.bincount(self.owner[code[self.must] < 0], minlength=len(self.ids)) == 0
        for n in np.unique(self.shape[alive]).tolist():
            shape, own, codes = self.shapes[n]
            mine = alive[own]
            for found in _matches(index, code[codes[mine]], own[mine], shape, self.best):
                self.waiting.append(found)
                self.n += len(found[0])
                if self.n >= WAITING:
                    self.rank()
        if self.n >= len(self.ids):
            self.rank()

    def rank(self) -> None:
        if self.waiting:
            self.best.add(*self.waiting)
            self.waiting, self.n = [], 0


def _search(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Asked] = {}
        last, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in known:
                    known[block] = _Asked(batch.column("asked")[i].values, limit)
                ids, news, sizes, codes = (batch.column(c)[i].values.to_numpy() for c in ("ids", "news", "sizes", "codes"))
                mark = (int(ids[0]), int(ids[-1]), len(ids), len(codes))
                if mark != last:
                    order = np.argsort(~news, kind="stable")
                    _, place = runs((np.cumsum(sizes) - sizes)[order], sizes[order])
                    last, index = mark, Index(ids[order], news[order], sizes[order], codes[place], batch.column("terms")[i].values)
                    index.count_often()
                known[block].meet(index)
        for asked in known.values():
            asked.rank()
            q, rank, news, own = asked.best.rows
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(own), pa.array(news), pa.array(rank)], ["query_id", "id", "newer", "rank"])

    return run


#: One of so many texts is searched first where queries are many, for the rank and time that a query's first rows have at least.
SAMPLE = 16


def in_two_steps(texts: DataFrame, queries: DataFrame, limit: int, many: int, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """search(texts, queries with floor and floor_newer), over all texts.

    What a task hands on grows with the tasks, unless a query's `limit`-th row among a part of the texts is known to all of
    them: with more than `many` queries a SAMPLE-th of the texts goes first, and its rows are handed on as well.
    """
    none = queries.withColumns({"floor": F.lit(None).cast("double"), "floor_newer": F.lit(None).cast("long")})
    if queries.count() <= many:
        return search(texts, none)
    bucket = F.pmod(F.xxhash64("id"), F.lit(SAMPLE))
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.desc("newer"), "id")
    first = search(texts.where(bucket == 0), none).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    first = stored(first, "first-rows")
    floors = first.where(F.col("nth") == limit).select("query_id", F.col("rank").alias("floor"), F.col("newer").alias("floor_newer"))
    rest = search(texts.where(bucket != 0), queries.join(floors, "query_id", "left"))
    return first.drop("nth").unionByName(rest)


def best_texts(texts: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, newer, rank): candidates for each query's first `limit` texts, of each task the best.

    texts (id long, newer long: larger comes first in a tie, text), asked: as search makes them of the queries (query_id, terms,
    wanted, parts, nevers).
    """
    # the number of terms belongs to the shape, so that the terms of queries of one shape are a table
    shape = F.to_json(F.struct("parts", "nevers", "wanted", F.size("terms").alias("terms")))
    queries = stored(asked.select(F.col("query_id").cast("long").alias("query_id"), "terms", shape.alias("shape")), "text-queries")

    def search(some: DataFrame, queries: DataFrame) -> DataFrame:
        corpus = some.select("id", "newer", X.tokenize(F.col("text"))).mapInArrow(tidy(to_blocks), BLOCKS)
        blocks = query_blocks(queries, F.octet_length(F.array_join("terms", " ")) + F.octet_length("shape") + 32, QUERIES, PART)
        return against(corpus, blocks, _search(limit), _HITS)

    return in_two_steps(texts.select(F.col("id").cast("long").alias("id"), F.col("newer").cast("long").alias("newer"), "text"), queries, limit, QUERIES, search)
