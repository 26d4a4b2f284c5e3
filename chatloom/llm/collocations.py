"""Phrase collocation mining: which words of a language go together?

A language's phrases of 2 to 4 words are counted in counting quotient filters (quotient_filter.py). The way there:

1. Texts become blocks of a few megabytes: a block's different words, and its text as numbers into them, with 0
   between pieces.
2. Words are counted by language over all blocks; frequent ones get dense ids, which go back to their blocks by
   a join. Phrases with a rarer word cannot be frequent.
3. For each length, each block counts its phrases in a filter, cut by ranges of the permuted key. Filters of one
   range are merged, and keys that are frequent keep their count; their ids come from the inverse
   permutation. Then the next length takes only phrases whose two shorter parts may be frequent: one bit
   for each of 2^BITMAP ranges of keys says whether a frequent phrase lies in it. A wrongly set bit costs
   time only.
4. Scores, covering phrases and ranks are joins of frequent phrases.

Null text is empty, null lang is `und`. Repeated rows count as often as they occur; ids play no part. A text
of over SLICE bytes is cut after a piece; only one without any piece's end is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .numbering import numbered
from .shared import materialise, tidy

#: Bytes of text in a block.
BLOCK = 1 << 23
#: Bytes of text that are taken apart at once.
SLICE = 1 << 22
#: Phrases that one range of keys should have at most when all blocks' filters are merged.
RANGE = 1 << 21
#: Bits of the bitmap's index: 2^26 bits are 8 MB, whatever the number of phrases.
BITMAP = 26
#: Parts of a lang's phrases that are ranked on their own first.
DEALT = 64

_U = np.uint64
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD, _IS_END = np.ones(256, bool), np.zeros(256, bool)
_IN_WORD[[32, 9, *_ENDS]] = False
_IS_END[[*_ENDS]] = True

BLOCKS = "block long, lang string, words array<string>, counts array<long>, sequence binary"


def _split_words(buf: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, number of the piece of each) of texts that lie one after the other, beginning at begins."""
    buf = _LOWER[buf]
    inside = _IN_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(buf)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    breaks = _IS_END[buf].astype(np.int32)
    breaks[begins] += 1
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    letters = buf[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(letters)) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words, piece


def _pieces_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in slices that end with a piece."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data):  # on to the next end of a piece
            stop = np.flatnonzero(_IS_END[data[end : end + SLICE]])
            end = end + int(stop[0]) + 1 if len(stop) else min(len(data), end + SLICE)
            if len(stop):
                break
        yield data[at:end]
        at = end


def _block(lang: str, texts: list[np.ndarray], block: int) -> pa.RecordBatch:
    words, pieces, at, run, size = [], [], 0, [], 0
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text)
        if size >= SLICE or i == len(texts) - 1:
            lengths = np.array([len(t) for t in run])
            w, p = _split_words(np.concatenate(run), np.cumsum(lengths) - lengths)
            words.append(w.dictionary_encode())
            pieces.append(p + at)
            at, run, size = at + (int(p[-1]) if len(p) else 0) + 1, [], 0
    encoded = pa.chunked_array(words).unify_dictionaries().combine_chunks() if words else pa.array([], pa.large_string()).dictionary_encode()
    encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    index, piece = encoded.indices.to_numpy(), np.concatenate(pieces) if pieces else np.empty(0, np.int32)
    new = np.ones(len(index), bool)
    new[1:] = piece[1:] != piece[:-1]
    sequence = np.zeros(len(index) + int(new.sum()), "<u4")
    sequence[np.arange(len(index)) + np.cumsum(new)] = index + 1
    counts = np.bincount(index, minlength=len(encoded.dictionary))
    one = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(encoded.dictionary)], pa.int32()), encoded.dictionary.cast(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([sequence.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(one, ["block", "lang", "words", "counts", "sequence"])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of each few megabytes of texts (lang, text)."""
    texts: dict[str, list[np.ndarray]] = {}
    size, block = 0, TaskContext.get().partitionId() << 32

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal size, block
        for lang, own in texts.items():
            yield _block(lang, own, block)
            block += 1
        texts.clear()
        size = 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _pieces_of(np.frombuffer(text.as_buffer(), np.uint8)):
                texts.setdefault(lang, []).append(part)
                size += len(part)
                if size >= BLOCK:
                    yield from emit()
    yield from emit()


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (lang, text): block, lang, words, counts, sequence (numbers into words from 1, 0 before each piece)."""
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.where(F.length("text") > 0).mapInArrow(tidy(_to_blocks), BLOCKS)


def _widths(n: int, bits: int) -> tuple[int, int]:
    return (n // 2) * bits, (n - n // 2) * bits


def _grams(ids: np.ndarray, n: int, bits: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys of all runs of n ids other than 0 whose two shorter parts may be frequent."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, _U)
    whole = ids[:m] != 0
    for i in range(1, n):
        whole &= ids[i : m + i] != 0
    at = np.flatnonzero(whole)
    if known is not None and len(at):
        # a run of n - 1 words stands at each place and the next one
        places = np.unique(np.concatenate([at, at + 1]))
        left, right = qf.permute(*_packed(ids, places, n - 1, bits), _widths(n - 1, bits))
        slot = _slot(left, right, _widths(n - 1, bits))
        ok = np.zeros(len(ids) + 1, bool)
        ok[places] = known[slot >> 3] & (1 << (slot & 7).astype(np.uint8)) != 0
        at = at[ok[at] & ok[at + 1]]
    return qf.permute(*_packed(ids, at, n, bits), _widths(n, bits))


def _packed(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    halves = []
    for places in (range(n // 2), range(n // 2, n)):
        word = np.zeros(len(at), _U)
        for i in places:
            word = word << _U(bits) | ids[at + i].astype(_U)
        halves.append(word)
    return halves[0], halves[1]


def _slot(left: np.ndarray, right: np.ndarray, widths: tuple[int, int], bits: int = BITMAP) -> np.ndarray:
    """The leading bits of a permuted key as a number of `bits` bits (a shorter key is taken as it is)."""
    if widths[0] >= bits:
        return (left >> _U(widths[0] - bits)).astype(np.int64)
    low = bits - widths[0]
    return (left << _U(low) | (right >> _U(widths[1] - low) if widths[1] >= low else right)).astype(np.int64)


def _filters(batches: Iterator[pa.RecordBatch], n: int, bits: int, ranges: dict[str, int], known) -> Iterator[pa.RecordBatch]:
    """Each block's phrases of n words as filters (lang, range, filter)."""
    maps = known.value if known else {}
    widths = _widths(n, bits)
    for batch in batches:
        for lang, ids in zip(batch.column("lang").to_pylist(), batch.column("ids"), strict=True):
            left, right = _grams(np.frombuffer(ids.as_buffer(), "<u4"), n, bits, maps.get(lang) if known else None)
            if not len(left):
                continue
            left, right, counts = qf.sum_equal(left, right, None, widths)
            part = (_slot(left, right, widths).astype(_U) * _U(ranges[lang]) >> _U(BITMAP)).astype(np.int64)  # in order, as keys are
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            begin, rows = 0, []
            for end in ends.tolist():
                rows.append((int(part[begin]), qf.pack(left[begin:end], right[begin:end], counts[begin:end], widths)))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "range", "filter"])


def _frequent(n: int, bits: int, min_count: int):
    """A function that gives the frequent phrases of one range's filters: lang, gram (ids), a, slot."""
    widths = _widths(n, bits)

    def frequent(table: pa.Table) -> pa.Table:
        left, right, counts = qf.merge((f.as_buffer() for f in table.column("filter")), widths)
        keep = counts >= min_count
        left, right, counts = left[keep], right[keep], counts[keep]
        slot = _slot(left, right, widths)
        left, right = qf.restore(left, right, widths)
        words = [word >> _U(bits * (m - 1 - i)) & qf.mask(bits) for word, m in ((left, n // 2), (right, n - n // 2)) for i in range(m)]
        flat = np.stack(words, axis=1).astype(np.int64).ravel()
        grams = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * n, pa.int32()), pa.array(flat))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(counts), pa.string()), "gram": grams, "a": pa.array(counts), "slot": pa.array(slot)})

    return frequent


def _bitmaps(slots: DataFrame, width: int) -> dict[str, np.ndarray]:
    """A bit for each slot of each lang; Spark gathers the bits of a byte before they come here."""
    out: dict[str, np.ndarray] = {}
    octets = slots.groupBy("lang", F.shiftright("slot", 3).alias("octet")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 7 as int))")).alias("bits"))
    pages = octets.groupBy("lang", F.shiftright("octet", 16).alias("page")).agg(F.collect_list(F.struct("octet", "bits")).alias("octets"))
    for lang, octets_, bits_ in pages.select("lang", "octets.octet", "octets.bits").toLocalIterator():
        out.setdefault(lang, np.zeros(1 << (BITMAP - 3), np.uint8))[np.array(octets_)] = np.array(bits_, np.uint8)
    return out


def count_phrases(docs: DataFrame, longest: int = 4, min_count: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases, words and totals of docs (lang, text).

    (lang, gram, a): ids and occurrences of each run of up to `longest` words within a piece that occurs min_count
    times; (lang, id, word, a): the words; (lang, n): all word occurrences of each lang.
    """
    spark = docs.sparkSession
    blocks = materialise(text_blocks(docs), "blocks")
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "lang", "place", "w.*")
    words = materialise(listed.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("a")).where(F.col("a") >= min_count), "words")
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    words = materialise(numbered(words, ["lang"], ["word"], words.count(), "id").withColumn("id", F.col("id") + 1), "words")
    sizes = {r.lang: (r.ids, r.n) for r in words.groupBy("lang").agg(F.max("id").alias("ids"), F.sum("a").alias("n")).collect()}
    bits = max([1, *(ids.bit_length() for ids, _ in sizes.values())])
    # ids go back to the blocks that have their words
    found = listed.join(words.select("lang", F.col("word").alias("words"), "id"), ["lang", "words"]).groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))
    sequences = materialise(blocks.select("block", "lang", "sequence").join(found, "block").select("lang", "places", "ids", "sequence").mapInArrow(tidy(_with_ids), "lang string, ids binary"), "sequences")

    frequent, known = [words.select("lang", F.array("id").alias("gram"), "a")], None
    for n in range(2, longest + 1):
        ranges = {lang: 1 + total // RANGE for lang, (_, total) in sizes.items()}
        filters = sequences.mapInArrow(tidy(partial(_filters, n=n, bits=bits, ranges=ranges, known=known)), "lang string, range long, filter binary")
        merged = filters.groupBy("lang", "range").applyInArrow(_frequent(n, bits, min_count), "lang string, gram array<long>, a long, slot long")
        merged = materialise(merged, f"phrases-{n}")
        frequent.append(merged.select("lang", "gram", "a"))
        if n < longest:
            maps = _bitmaps(merged.select("lang", "slot"), BITMAP)
            known = spark.sparkContext.broadcast({lang: maps.get(lang, np.zeros(1 << (BITMAP - 3), np.uint8)) for lang in sizes})
    every = frequent[0]
    for f in frequent[1:]:
        every = every.union(f)
    return every, words, totals


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of word ids in place of numbers into a block's words; 0 also for rare words."""
    for batch in batches:
        for i in range(len(batch)):
            lang, places, ids, sequence = (batch.column(j)[i] for j in range(4))
            numbers = np.frombuffer(sequence.as_buffer(), "<u4")
            table = np.zeros(int(numbers.max(initial=0)) + 1, "<u4")
            table[places.values.to_numpy() + 1] = ids.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([table[numbers].tobytes()], pa.binary())], ["lang", "ids"])


def phrases(docs: DataFrame, longest: int = 4, min_count: int = 30, top: int = 2000) -> DataFrame:
    """Each lang's top phrases of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    score is the lowest floor(2,000,000 a / (l + r)) over all cuts of a phrase in two, l and r being the parts'
    counts. Phrases inside a longer one that occurs at least 80 % as often are left out.
    """
    every, words, totals = count_phrases(docs, longest, min_count)
    parts = every.where(F.size("gram") < longest)
    candidates = every.where(F.size("gram") > 1)
    cuts = candidates.select("lang", "gram", "a", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("gram", F.lit(1), F.col("k")), "rest": F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k"))})
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("gram").alias(part), F.col("a").alias(count)), ["lang", part])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (l + r)"))
    scored = cuts.groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "gram", "c.score", "c.a", "c.l", "c.r")

    inner = [F.slice("gram", i, size) for size in range(2, longest) for i in range(1, longest - size + 2)]
    sizes = [(size, i) for size in range(2, longest) for i in range(1, longest - size + 2)]
    inside = F.filter(F.array(*(F.when((F.size("gram") > size) & (F.size("gram") >= size + i - 1), x) for (size, i), x in zip(sizes, inner, strict=True))), lambda x: x.isNotNull())
    longer = candidates.where(F.size("gram") > 2).select("lang", F.col("a").alias("longer"), F.explode(inside).alias("gram")).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "gram"], "left").where(F.col("longer").isNull() | (5 * F.col("longer") < 4 * F.col("a")))

    # names only for those that can be among the first: of each of DEALT parts of a lang, then of all of it, so that what
    # meets in one task does not grow with the number of tasks
    by = [F.desc("score"), F.desc("a")]
    near = kept.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(DEALT)))
    for keys in (["lang", "part"], ["lang"]):
        near = near.withColumn("near", F.rank().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("near") <= top)
    near = materialise(near.drop("near", "part"), "ranked")
    placed = near.select("lang", "gram", F.posexplode("gram").alias("place", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = placed.groupBy("lang", "gram").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = near.join(named, ["lang", "gram"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
