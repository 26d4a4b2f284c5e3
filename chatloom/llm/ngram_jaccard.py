"""N-gram Jaccard join: which documents share at least 80 % of their five-word shingles.

The method is a count-vector R-tree. A document's shingles are hashed into groups and the group
counts are its point; two documents share at most the sum of the coordinate minima of their
points, so a pair or a page whose bound is too low is never compared, and pairs that survive are
verified on the shingle sets. A point has a power of two of groups, an eighth of the set's size
or more, so that unrelated texts of any length differ enough; a longer point is folded by adding
its halves when it meets a shorter one.

A corpus-wide tree would compare far too much: unrelated texts have near-equal counts when groups
are few, and bounding boxes of unrelated texts cover everything when groups are many. The points
are therefore first dealt into families that no link can leave:

1. The shingles are hashed once more, into many small cells. Linked sets of sizes a and b differ in
   at most (a + b) / 9 <= a / 4 shingles, so among the first a / 4 + 1 filled cells of either at
   least one is the same in both. Those cells' contents are the document's keys; documents that
   share no key are not linked. Cells of very common shingles come last in the order.
2. Documents under one key are paired, and pairs within the bound make families. Where many share a
   key (a passage, or a large group of copies), their points are packed into pages, pages whose
   corners leave a link possible are met, and only a spanning forest of the bounded pairs is kept.
3. Each family is packed, in order of size and coordinates, into pages of up to PAGE points with
   an upper corner: the leaves of its tree. Pages are joined within, then their representatives
   with the family's first, then those pairs of pages that are not one component yet and whose
   corners leave a link possible. Every pair that shares a key is thus verified, ruled out by
   the bound or already connected; no group is expanded into all pairs.

Equal sets are one point. Nothing but the common shingles of a bounded sample, and the set ids
to fetch if they are at most BROADCAST_SETS, goes through the driver.

Defined results: null text, empty text and text without words has no shingles and is linked with
nothing. Repeated rows are linked with each other. A null id is larger than all others: a
component of null ids only has the component id null. Ties do not arise: a pair is linked or it is
not. A very long text is one set of all its shingles, hashed in pieces. An empty table gives no rows.
Only the id and the text are read, so other columns cannot clash; `keep_one` keeps all columns.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import materialise, shuffle_width, tidy
from .words import SPACE_WORDS, mix, shingle_sets, slices, text_buffers, word_hashes

#: Fewest and most groups of a point.
GROUPS, MOST_GROUPS = 32, 1 << 16
PAGE = 128
#: Points in a page of those under one key.
KEY_PAGE = 1024
#: Documents under one key up to which all of them are paired.
SMALL = 16
#: Documents of the sample that tells common shingles, and in how many of them one must be.
HOT_SAMPLE, HOT = 8000, 8
#: Set ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_SETS = 2_000_000
#: Bits that mark the rows which keep_one's last join must look at: at most so many / 64 rows are broadcast.
MARK_BITS = 1 << 25
#: Keys that a task gathers before it hands them on.
FLUSH = 250_000

_U = np.uint64


def _sets(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, shingles, offsets, set ids) by slices."""
    buf, offsets = text_buffers(col)
    for i, j in slices(offsets):
        h, woffs = word_hashes(buf, offsets[i : j + 1], SPACE_WORDS)
        vals, offs = shingle_sets(h, woffs)
        n = np.diff(offs)
        ids = np.zeros(j - i, np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            add = np.add.reduceat(mix(vals ^ _U(0xA5A5A5A5)), offs[some])
            xor = np.bitwise_xor.reduceat(mix(vals + _U(0x5EED5EED)), offs[some])
            ids[some] = mix(add + mix(xor + n[some].astype(np.uint64)))
        yield i, j, vals, offs, ids.view(np.int64)


def _points(vals: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Group counts of each set."""
    low = (mix(vals ^ _U(0xB0B)) & _U(MOST_GROUPS - 1)).astype(np.int64)
    out = []
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        d = min(MOST_GROUPS, max(GROUPS, 1 << (max(1, j - i) - 1).bit_length() >> 3))
        out.append(np.bincount(low[i:j] & (d - 1), minlength=d))
    return out


def _point_column(points: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, points)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(points) if points else [], pa.int32()))


def _same_width(*points: list) -> list[np.ndarray]:
    """Matrices of the point lists, folded to the fewest groups among them."""
    d = min(len(p) for side in points for p in side)
    return [np.array([np.asarray(p, np.int32).reshape(-1, d).sum(0, dtype=np.int32) for p in side]) for side in points]


def set_ids(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sid (id of the shingle set, null if empty), n (its size) and point (group counts) for the text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            point = []
            for i, j, vals, offs, ids in _sets(b.column(at)):
                sid[i:j], n[i:j] = ids, np.diff(offs)
                point += _points(vals, offs)
            cols = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sid, mask=n == 0), pa.array(n), _point_column(point)], [*(x for x in b.schema.names if x != text_col), "sid", "n", "point"])

    kept = [f for f in docs.schema.fields if f.name != text_col]
    added = [T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("point", T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(tidy(run), T.StructType([*kept, *added]))


def common_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that many documents of a bounded sample hold. They only order the keys."""
    every = max(1, docs.count() // HOT_SAMPLE)
    sample = docs.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)).select(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, vals, _, _ in _sets(b.column(0)):
                v, n = np.unique(vals.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], ["s", "n"])

    rows = sample.mapInArrow(tidy(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("s").toArrow()
    return np.sort(rows.column(0).to_numpy()).view(np.uint64) if rows.num_rows else np.empty(0, np.uint64)


def _grid_cells(band: np.ndarray) -> np.ndarray:
    """Cells of a size band [2^band, 2^(band + 1)): three quarters of its least size, so that even
    the largest sets fill more than a quarter of their size; small sets are spread far apart."""
    return np.where(band < 6, 1 << 20, (3 << band) >> 2).astype(np.uint64)


def keys_of(vals: np.ndarray, offs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set numbers): the contents of each set's first size / 4 + 1 filled cells.

    A set whose larger partners reach the next size band is keyed in both bands' cells.
    """
    n = np.diff(offs)
    some = np.flatnonzero(n)
    band = np.frexp(n[some].astype(float))[1] - 1
    up = n[some] * 5 // 4 >= 2 << band
    entry, band = np.concatenate([some, some[up]]), np.concatenate([band, band[up] + 1])
    size = n[entry]
    at = np.repeat(np.arange(len(entry)), size)
    v = vals[np.repeat(offs[entry], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    cell = mix(v ^ _U(0xC0FFEE)) % _grid_cells(band)[at]
    if len(common):
        i = np.minimum(np.searchsorted(common, v), len(common) - 1)
        cell += (common[i] == v).astype(np.uint64) << _U(39)
    place = (at.astype(np.uint64) << _U(40)) | cell
    order = np.argsort(place, kind="stable")
    place, v = place[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    content = np.add.reduceat(mix(v), first)
    at = (place[first] >> _U(40)).astype(np.int64)
    rank = np.arange(len(first)) - np.searchsorted(at, at)
    keep = rank <= size[at] // 4
    key = mix(content + mix((place[first] & _U((1 << 40) - 1)) + (band[at].astype(np.uint64) << _U(48))))
    return key[keep], entry[at[keep]]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, many): pairs of set ids a < b that share a key; with many set, a key and one of the many set ids under it."""
    spark = docs.sparkSession
    parts = 2 * shuffle_width(spark)
    shared = spark.sparkContext.broadcast(common_shingles(docs, id_col, text_col))

    def flush(keys: list[np.ndarray], sids: list[np.ndarray]) -> pa.RecordBatch:
        k, s = np.concatenate(keys), np.concatenate(sids)
        part = (k % _U(parts)).astype(np.int64)
        order = np.lexsort((s, part))
        k, s, part = k[order], s[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(edge[1:], len(k))
        rows = []
        for i, j in zip(edge, ends, strict=True):
            u, c = np.unique(s[i:j], return_counts=True)
            rows.append((int(part[i]), k[i:j].tobytes(), u.tobytes(), c.astype(np.uint32).tobytes()))
        p, kb, ub, cb = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kb, pa.binary()), pa.array(ub, pa.binary()), pa.array(cb, pa.binary())], ["part", "keys", "sids", "counts"])

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task hands each set on once: copies collapse before the shuffle
        keys, sids, held = [], [], 0
        for b in batches:
            for _, _, vals, offs, ids in _sets(b.column(0)):
                n = np.diff(offs)
                fresh = np.zeros(len(n), bool)
                for d in np.flatnonzero(n):
                    sid = int(ids[d])
                    if sid not in seen:
                        seen.add(sid)
                        fresh[d] = True
                if not fresh.all():
                    vals = vals[np.repeat(fresh, n)]
                    n = n[fresh]
                    offs, ids = np.concatenate([[0], np.cumsum(n)]), ids[fresh]
                k, at = keys_of(vals, offs, shared.value)
                if len(k):
                    keys.append(k)
                    sids.append(ids[at])
                    held += len(k)
                if held >= FLUSH:
                    yield flush(keys, sids)
                    keys, sids, held = [], [], 0
        if held:
            yield flush(keys, sids)

    def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "part"):
            keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            sids = np.concatenate([np.repeat(np.frombuffer(r["sids"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows])
            a, b, many = sharing(keys, sids)
            for at in range(0, len(a), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(many[s])], ["a", "b", "many"])

    blobs = docs.select(text_col).mapInArrow(tidy(key_rows), "part int, keys binary, sids binary, counts binary")
    found = blobs.repartition(shuffle_width(spark), "part").sortWithinPartitions("part").mapInArrow(tidy(found_rows), "a long, b long, many boolean")
    return found.distinct()


def sharing(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b, many) of the set ids under each key."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[fresh], sids[fresh]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(int(m), 1)
        at = begin[size == m][:, None]
        a.append(sids[at + i].ravel())
        b.append(sids[at + j].ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[first], b[first]
    rest = np.repeat(size > SMALL, size)
    a, b = np.concatenate([a, keys[rest].view(np.int64)]), np.concatenate([b, sids[rest]])
    return a, b, np.arange(len(a)) >= first.sum()


def chosen_sets(docs: DataFrame, sids: DataFrame, text_col: str) -> DataFrame:
    """(sid, n, point array<int>, shingles binary) of the documents whose set id is asked for; copies may repeat."""
    n = sids.count()
    few = np.sort(sids.select("sid").toArrow().column(0).to_numpy()) if n <= BROADCAST_SETS else None
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for b in batches:
            for _, _, vals, offs, ids in _sets(b.column(0)):
                ok = np.diff(offs) > 0
                if known is not None:
                    ok &= known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids if len(known) else False
                pick = []
                for d in np.flatnonzero(ok):
                    if int(ids[d]) not in seen:
                        seen.add(int(ids[d]))
                        pick.append(d)
                if pick:
                    points = _points(vals, offs)
                    raw = [vals[offs[d] : offs[d + 1]].tobytes() for d in pick]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(np.diff(offs)[pick]), _point_column([points[d] for d in pick]), pa.array(raw, pa.binary())], ["sid", "n", "point", "shingles"])

    rows = docs.select(text_col).mapInArrow(tidy(run), "sid long, n long, point array<int>, shingles binary")
    return rows if few is not None else rows.join(sids, "sid", "left_semi")


def _enough(overlap, a, b):
    """100 |A and B| >= 80 |A or B|."""
    return 9 * overlap >= 4 * (a + b)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    i = np.searchsorted(y, x)
    return int((y[np.minimum(i, len(y) - 1)] == x).sum())


def _bounded_pairs(p: list, n: np.ndarray, q: list, m: np.ndarray) -> np.ndarray:
    """Index pairs whose summed coordinate minima leave a link possible."""
    p, q = _same_width(p, q)
    rows = max(1, (1 << 21) // q.size)
    out = []
    for at in range(0, len(p), rows):
        overlap = np.minimum(p[at : at + rows, None], q[None]).sum(2)
        out.append(np.argwhere(_enough(overlap, n[at : at + rows, None], m[None])) + [at, 0])
    return np.concatenate(out)


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in blobs]


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 62) -> Iterator[list[dict]]:
    """Rows of equal keys that follow each other, at most so many at once."""
    rows: list[dict] = []
    for b in batches:
        for at in range(0, b.num_rows, PAGE):
            for r in b.slice(at, PAGE).to_pylist():
                if rows and (rows[0][key] != r[key] or len(rows) == most):
                    yield rows
                    rows = []
                rows.append(r)
    if rows:
        yield rows


def _pages(family_points: DataFrame) -> DataFrame:
    """(sid, fam, page): points in order of family, size and coordinates, PAGE to a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fam, filled, page, last = None, 0, None, None
        for b in batches:
            out = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s == last:
                    continue
                if f != fam or filled == PAGE:
                    fam, filled, page = f, 0, s  # a page is named by its first set
                filled, last = filled + 1, s
                out.append((s, f, page))
            cols = [*zip(*out, strict=True)] if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sid", "fam", "page"])

    rows = family_points.select("fam", "sid", "n", *(F.get("point", F.lit(i)).alias(f"c{i}") for i in range(3)))
    order = ["fam", "n", "c0", "c1", "c2", "sid"]
    width = shuffle_width(family_points.sparkSession)
    return rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select("fam", "sid").mapInArrow(tidy(run), "sid long, fam long, page long")


def _join_within(rows: DataFrame) -> DataFrame:
    """(sid, fam, page, local): local is the smallest set id linked within the page. rows come page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "page"):
            group = [*{r["sid"]: r for r in group}.values()]
            sets, n = _unpack([r["shingles"] for r in group]), np.array([r["n"] for r in group])
            points, u = [r["point"] for r in group], _Union(len(group))
            for i, j in _bounded_pairs(points, n, points, n):
                if i < j and u.find(i) != u.find(j) and _enough(_shared(sets[i], sets[j]), n[i], n[j]):
                    u.join(i, j)
            sid = [r["sid"] for r in group]
            least: dict[int, int] = {}
            for i, s in enumerate(sid):
                least[u.find(i)] = min(s, least.get(u.find(i), s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid, pa.int64()), pa.array([r["fam"] for r in group], pa.int64()), pa.array([r["page"] for r in group], pa.int64()), pa.array([least[u.find(i)] for i in range(len(sid))], pa.int64())],
                ["sid", "fam", "page", "local"],
            )

    return rows.mapInArrow(tidy(run), "sid long, fam long, page long, local long")


def _verify_rows(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, x binary, y binary) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = _unpack([x.as_py(), y.as_py()])
                keep.append(_enough(_shared(x, y), len(x), len(y)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _page_blobs(rows: DataFrame) -> DataFrame:
    """A row for each page of rows (page, sid, n, comp, point, shingles), which come page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "page"):
            group = [*{r["sid"]: r for r in group}.values()]
            (point,) = _same_width([r["point"] for r in group])
            cols = [
                pa.array([group[0]["page"]], pa.int64()),
                *(pa.array([np.array([r[c] for r in group], np.int64).tobytes()], pa.binary()) for c in ("n", "comp")),
                pa.array([point.tobytes()], pa.binary()),
                pa.array([b"".join(r["shingles"] for r in group)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["page", "n", "comp", "point", "shingles"])

    return rows.mapInArrow(tidy(run), "page long, n binary, comp binary, point binary, shingles binary")


def _page_boxes(rows: DataFrame) -> DataFrame:
    """(fam, page, low, high, c, d, upper) of each page: sizes, least and greatest component, upper corner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "page"):
            (point,) = _same_width([r["point"] for r in group])
            n, comp = [r["n"] for r in group], [r["comp"] for r in group]
            row = (group[0]["fam"], group[0]["page"], min(n), max(n), min(comp), max(comp))
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([point.max(0).tolist()], pa.list_(pa.int32()))], ["fam", "page", "low", "high", "c", "d", "upper"])

    return rows.mapInArrow(tidy(run), "fam long, page long, low long, high long, c long, d long, upper array<int>")


def _join_pages(pairs: DataFrame) -> DataFrame:
    """(a, b): components linked by documents of two pages; rows hold both pages' blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for at in range(b.num_rows):
                side = []
                for c in (0, 4):
                    n, comp = (np.frombuffer(b.column(c + k)[at].as_py(), np.int64) for k in (0, 1))
                    point = np.frombuffer(b.column(c + 2)[at].as_py(), np.int32).reshape(len(n), -1)
                    sets = np.split(np.frombuffer(b.column(c + 3)[at].as_py(), np.uint64), np.cumsum(n)[:-1])
                    side.append((n, comp, point, sets))
                (n, comp, point, sets), (m, other, point2, sets2) = side
                number = {c: i for i, c in enumerate(dict.fromkeys([*comp.tolist(), *other.tolist()]))}
                u = _Union(len(number))
                for i, j in _bounded_pairs(point, n, point2, m):
                    x, y = number[int(comp[i])], number[int(other[j])]
                    if u.find(x) != u.find(y) and _enough(_shared(sets[i], sets2[j]), n[i], m[j]):
                        u.join(x, y)
                        found.add((int(comp[i]), int(other[j])))
            cols = [*zip(*sorted(found), strict=True)] if found else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    names = [f"{c}{k}" for k in (1, 2) for c in ("n", "comp", "point", "shingles")]
    return pairs.select(*names).mapInArrow(tidy(run), "a long, b long")


def _joined(u: _Union, p: list, n: np.ndarray, q: list, m: np.ndarray, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """Joins the nodes of all pairs within the bound; yields the nodes of those that were apart. Ends when all are one."""
    p, q = _same_width(p, q)
    apart = len({u.find(x) for x in [*left, *right]}) - 1
    rows = max(1, (1 << 20) // q.size)
    for at in range(0, len(p), rows):
        if not apart:
            return
        overlap = np.minimum(p[at : at + rows, None], q[None]).sum(2)
        for i, j in np.argwhere(_enough(overlap, n[at : at + rows, None], m[None])):
            x, y = left[at + i], right[j]
            if u.find(x) != u.find(y):
                u.join(x, y)
                apart -= 1
                yield x, y


def _point_pages(members: DataFrame) -> DataFrame:
    """A row for each page of rows (key, sid, n, point): KEY_PAGE points of a key, in order of size and
    coordinates. heads has, for each point, the smallest set id that pairs within the bound join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "key", KEY_PAGE):
            part.sort(key=lambda r: r["sid"])  # the smallest id of a component is its root
            (point,) = _same_width([r["point"] for r in part])
            n, sids, u = np.array([r["n"] for r in part]), np.array([r["sid"] for r in part]), _Union(len(part))
            own = [*range(len(part))]
            for _ in _joined(u, point, n, point, n, own, own):
                pass
            cols = [
                pa.array([part[0]["key"]], pa.int64()), pa.array([part[0]["sid"]], pa.int64()), pa.array([int(n.min())], pa.int64()), pa.array([int(n.max())], pa.int64()), pa.array([point.max(0).tolist()], pa.list_(pa.int32())),
                *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (sids, sids[[u.find(i) for i in own]], n)), pa.array([point.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "page", "low", "high", "upper", "sids", "heads", "ns", "points"])

    order = ["key", "n", "c0", "c1", "c2", "sid"]
    rows = members.select("key", "sid", "n", "point", *(F.get("point", F.lit(i)).alias(f"c{i}") for i in range(3)))
    rows = rows.repartitionByRange(shuffle_width(members.sparkSession), *order).sortWithinPartitions(*order).select("key", "sid", "n", "point")
    return rows.mapInArrow(tidy(run), "key long, page long, low long, high long, upper array<int>, sids binary, heads binary, ns binary, points binary")


def _sizes_fit(k: int, j: int):
    return (4 * F.col(f"low{k}") <= 5 * F.col(f"high{j}")) & (4 * F.col(f"low{j}") <= 5 * F.col(f"high{k}"))


def _pairs_within(rows: DataFrame, keep: list[str], points: tuple[str, str], sizes: tuple[str, str]) -> DataFrame:
    """rows[keep] whose two points (or corners) leave a link of sizes at least these possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for i, (p, q, m, n) in enumerate(zip(*(part.column(len(keep) + c).to_pylist() for c in range(4)), strict=True)):
                    p, q = _same_width([p], [q])
                    ok[at + i] = _enough(int(np.minimum(p, q).sum()), m, n)
            yield b.select(range(len(keep))).filter(pa.array(ok))

    return rows.select(*keep, *points, *sizes).mapInArrow(tidy(run), rows.select(*keep).schema)


def bounded_forest(members: DataFrame) -> DataFrame:
    """(a, b): edges that join, for each key, what its points' pairs within the bound join."""
    pages = materialise(_point_pages(members), "key-pages")
    cols = ("heads", "ns", "points")
    one, two = (pages.select("key", *(F.col(c).alias(f"{c}{k}") for c in ("page", "low", "high", "upper", *cols))) for k in (1, 2))
    keep = [f"{c}{k}" for k in (1, 2) for c in cols]
    pairs = _pairs_within(one.join(two, "key").where((F.col("page1") < F.col("page2")) & _sizes_fit(1, 2)), keep, ("upper1", "upper2"), ("low1", "low2"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, h in zip(*b.columns, strict=True):
                s, h = np.frombuffer(s.as_py(), np.int64), np.frombuffer(h.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[s != h]), pa.array(s[s != h])], ["a", "b"])

    def bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*b.columns, strict=True):
                h1, n1, p1, h2, n2, p2 = (np.frombuffer(x.as_py(), np.int32 if c % 3 == 2 else np.int64) for c, x in enumerate(row))
                heads = [*dict.fromkeys([*h1.tolist(), *h2.tolist()])]
                number = {x: i for i, x in enumerate(heads)}
                left, right = [number[x] for x in h1.tolist()], [number[x] for x in h2.tolist()]
                for x, y in _joined(_Union(len(heads)), p1.reshape(len(h1), -1), n1, p2.reshape(len(h2), -1), n2, left, right):
                    out.append(sorted((heads[x], heads[y])))
            cols = [*zip(*out, strict=True)] if out else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    near = pages.select("sids", "heads").mapInArrow(tidy(stars), "a long, b long")
    return near.union(pairs.select(*keep).mapInArrow(tidy(bridges), "a long, b long")).distinct()


def _by_page(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "page").sortWithinPartitions("page", "sid")


def linked_sets(docs: DataFrame, own: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sid, comp) of the sets that may have a partner: sets of equal comp are linked. own: set_ids of the docs."""
    found = materialise(candidates(docs, id_col, text_col), "candidates")
    points = own.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    asked = found.select(F.explode(F.when(F.col("many"), F.array("b")).otherwise(F.array("a", "b"))).alias("sid")).distinct()
    points = materialise(points.join(asked, "sid"), "candidate-points")

    # the bound on pairs, then families
    side = lambda c: points.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    pairs = found.where("not many").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    near = _pairs_within(pairs, ["a", "b"], ("p_a", "p_b"), ("n_a", "n_b"))
    many = found.where("many").select(F.col("a").alias("key"), F.col("b").alias("sid")).join(points, "sid")
    family = components(near.union(bounded_forest(many))).select(F.col("node").alias("sid"), F.col("comp").alias("fam"))
    pages = materialise(_pages(points.join(family, "sid")), "pages")
    sets = materialise(chosen_sets(docs, pages, text_col), "family-sets")

    local = materialise(_join_within(_by_page(sets.join(pages, "sid").select("sid", "fam", "page", "n", "point", "shingles"))), "page-components")
    links = local.select(F.col("sid").alias("a"), F.col("local").alias("b"))
    many = materialise(local.groupBy("fam").agg(F.min_by("local", F.struct("page", "local")).alias("pivot"), F.count_distinct("page").alias("pages")).where("pages > 1").select("fam", "pivot"), "large-families")
    if many.isEmpty():
        return links.toDF("sid", "comp")

    # large families: the components' representatives with the family's first
    heads = local.where("sid = local").join(many, "fam").where("local <> pivot").select(F.col("local").alias("a"), F.col("pivot").alias("b"))
    few = sets.join(heads.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    blob = lambda c, x: few.dropDuplicates(["sid"]).select(F.col("sid").alias(c), F.col("shingles").alias(x))
    star = materialise(_verify_rows(heads.join(blob("a", "x"), "a").join(blob("b", "y"), "b")), "representative-links")
    comp = components(star).toDF("local", "comp")
    joined = local.join(many, "fam", "left_semi").join(comp, "local", "left").select("sid", "fam", "page", F.coalesce("comp", "local").alias("comp"))
    joined = materialise(joined.join(points, "sid"), "large-family-points")

    # pages that are not one component and whose corners leave a link possible
    boxes = materialise(_page_boxes(_by_page(joined.select("sid", "page", "fam", "n", "comp", "point"))), "page-boxes")
    first, second = (boxes.select("fam", *(F.col(x).alias(f"{x}{k}") for x in ("page", "low", "high", "c", "d", "upper"))) for k in (1, 2))
    open_ = ~((F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("c1") == F.col("c2")))
    todo = first.join(second, "fam").where((F.col("page1") < F.col("page2")) & open_ & _sizes_fit(1, 2))
    todo = _pairs_within(todo, ["page1", "page2"], ("upper1", "upper2"), ("low1", "low2"))
    todo = materialise(todo, "page-pairs")
    if not todo.isEmpty():
        asked = todo.select(F.explode(F.array("page1", "page2")).alias("page")).distinct()
        blobs = joined.join(asked, "page", "left_semi").select("sid", "page", "comp").join(sets, "sid")
        blobs = materialise(_page_blobs(_by_page(blobs.select("sid", "page", "comp", "n", "point", "shingles"))), "page-blobs")
        one, two = (blobs.select(F.col("page").alias(f"page{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "comp", "point", "shingles"))) for k in (1, 2))
        star = star.union(_join_pages(todo.join(one, "page1").join(two, "page2").repartition(shuffle_width(docs.sparkSession))))
        star = star.union(joined.where("comp <> sid").select("sid", "comp").distinct().toDF("a", "b"))
    whole = components(links.union(star))
    return whole.toDF("sid", "comp")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = materialise(set_ids(rows), "set-ids")
    comp = linked_sets(rows, own, "id", "text")
    own = own.join(comp, "sid", "left").select("id", "n", "sid", F.coalesce("comp", "sid").alias("comp"))
    # written first, so that a large component's rows are split when AQE joins them
    least = materialise(own.where("sid is not null").groupBy("comp").agg(F.min("id").alias("least")), "least-ids")
    return own.join(least, "comp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component (the least id; null ids last) and all rows without shingles.

    Columns stay. Rows are told apart by id and text; rows that repeat both count as copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    own = materialise(set_ids(rows), "set-ids")
    comp = linked_sets(rows.select("id", "text"), own, "id", "text")
    own = own.where("sid is not null").join(comp, "sid", "left")
    own = materialise(own.groupBy(F.coalesce("comp", "sid").alias("comp"), "id", "th").agg(F.count("*").alias("copies")), "copies")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("th"))
    best = materialise(own.groupBy("comp").agg(F.min(order).alias("best")), "first-ids")
    judged = own.join(best, "comp").withColumn("stays", order == F.col("best"))
    judged = materialise(judged.where("not stays or copies > 1").select(F.col("id").alias("ng__id"), F.col("th").alias("ng__th"), "stays"), "dropped-ids")
    # of all rows only those whose bit is set can be among the judged; the others skip the join's shuffle
    at = "pmod(xxhash64(ng__id, ng__th), {0})".format(MARK_BITS)
    marks = judged.select(F.expr(at).alias("ng__h")).groupBy(F.expr("ng__h div 64").alias("ng__word")).agg(F.expr("bit_or(shiftleft(1L, cast(ng__h % 64 as int)))").alias("ng__bits"))
    marked = docs.withColumn("ng__h", F.pmod(F.xxhash64(docs[id_col], F.xxhash64(docs[text_col])), F.lit(MARK_BITS))).withColumn("ng__word", F.expr("ng__h div 64"))
    marked = marked.join(F.broadcast(marks), "ng__word", "left").withColumn("ng__hit", F.expr("coalesce(getbit(ng__bits, cast(ng__h % 64 as int)) = 1, false)"))
    sure, maybe = marked.where("not ng__hit").select(*docs.columns), marked.where("ng__hit").select(*docs.columns)
    same = maybe[id_col].eqNullSafe(F.col("ng__id")) & (F.xxhash64(maybe[text_col]) == F.col("ng__th"))
    out = maybe.join(judged.where("not stays"), same, "left_anti")
    twice = judged.where("stays")
    if twice.isEmpty():
        return sure.unionByName(out)
    same = out[id_col].eqNullSafe(F.col("ng__id")) & (F.xxhash64(out[text_col]) == F.col("ng__th"))
    once = out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return sure.unionByName(out.join(twice, same, "left_anti")).unionByName(once)
