"""Language identification by cross-parsing entropy.

One suffix automaton for each language is built over a bounded sample of labelled text. A text is
cut greedily into the longest phrases that occur in the sample; the language that needs the fewest
phrases for each character wins. Automata are dense transition tables, so thousands of text
segments advance together, one numpy step for each character.

Defined results: null text, empty text and text without a letter is `und` with score 0, as is
every text when nothing was learned. Ties go to the label that sorts first. Repeated rows are
judged alike. Very long texts are parsed whole, in segments; an empty table gives no rows. Columns
named like the outputs are replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import clear_after_task, tidy
from .words import slices, text_buffers

#: Bounds of the training sample: documents and characters for each label.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 24_000
#: A document's share of the sample is taken in windows of about so many characters.
WINDOW = 128
#: Long texts are parsed in segments of so many bytes, each starting a new phrase.
SEGMENT = 1024
_BYTES_AT_ONCE = 2 << 20


def _shares(lengths: list[int], chars: int) -> list[int]:
    """Characters to take from each text: alike, what short texts leave goes to the longer ones."""
    out, left = [0] * len(lengths), chars
    for done, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], left // (len(lengths) - done))
        left -= out[i]
    return out


def _windows(length: int, share: int, seed: int) -> list[tuple[int, int]]:
    """(start from 1, characters) of windows of share characters in all, one at a hashed place of each even part of the text."""
    if share <= 0:
        return []
    n = -(-share // WINDOW)
    out = []
    for k in range(n):
        lo, hi = k * length // n, (k + 1) * length // n
        size = min(hi - lo, (k + 1) * share // n - k * share // n)
        place = int.from_bytes(blake2b(f"{seed},{k}".encode(), digest_size=8).digest(), "big") % (hi - lo - size + 1)
        out.append((lo + place + 1, size))
    return out


def training_sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Label -> text: sample_chars (and blanks between windows) from each label's sample_docs different texts of least hashed id.

    usable: condition on the rows that may teach. Texts without a letter teach nothing, and copies
    count once (compared by 64-bit hashes). Each text gives an even share, spread over its whole length.
    """
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    w = Window.partitionBy("label").orderBy("h", "id", "th")
    picked = (
        rows.groupBy("label", "th")
        .agg(F.min("id").alias("id"), F.min(F.length("t")).alias("length"))
        .withColumn("h", F.xxhash64("id"))
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= sample_docs)
        .select("label", "id", "th", "length")
    )
    by_label: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.label, r.id, r.th)):
        by_label.setdefault(r.label, []).append(r)
    wanted = []
    for mine in by_label.values():
        for r, share in zip(mine, _shares([r.length for r in mine], sample_chars), strict=True):
            wanted.append((r.label, r.id, r.th, _windows(r.length, share, r.th)))
    if not wanted:
        return {}
    fields = [rows.schema[c] for c in ("label", "id", "th")]
    part = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])
    wanted = docs.sparkSession.createDataFrame(wanted, T.StructType([*fields, T.StructField("parts", T.ArrayType(part))]))
    texts = rows.join(F.broadcast(wanted), ["label", "id", "th"])
    cut = F.array_join(F.transform("parts", lambda x: F.substring(F.col("t"), x["at"], x["size"])), " ")
    found = {(r.label, r.id, r.th): r.t for r in texts.select("label", "id", "th", cut.alias("t")).collect()}
    out: dict[str, list[str]] = {}
    for key in sorted(found):
        out.setdefault(key[0], []).append(found[key])
    return {k: " ".join(v) for k, v in out.items()}


def _byte_codes() -> np.ndarray:
    code = np.full(256, 32, np.uint8)
    code[97:123] = np.arange(97, 123)
    code[128:] = np.arange(128, 256)
    return code


def _clean(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of other characters as one blank, and the new offsets."""
    c = _byte_codes()[buf[offsets[0] : offsets[-1]]]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    begins = offsets[:-1] - offsets[0]
    keep[begins[begins < len(c)]] = True  # a text's first blank stays, whatever text comes before it
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[offsets - offsets[0]]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class CrossParser:
    """Phrase counts of texts against each label's automaton."""

    def __init__(self, sample: dict[str, str]):
        self.labels = sorted(sample)
        parts = {}
        for label in self.labels:
            raw = np.frombuffer(sample[label].lower().encode(), np.uint8)
            parts[label] = _clean(raw, np.array([0, len(raw)]))[0]
        seen = sorted({int(x) for p in parts.values() for x in np.unique(p)})
        self.code = np.full(256, len(seen), np.int32)  # the last code: never seen
        self.code[seen] = np.arange(len(seen))
        self.width = width = len(seen) + 1
        self.tables = []
        for label in self.labels:
            nxt = suffix_automaton(self.code[parts[label]].tolist())
            root = np.full(width, ~0, np.int32)
            for c, s in nxt[0].items():
                root[c] = ~(s * width)
            t = np.repeat(root[None], len(nxt), 0)  # no transition: a new phrase begins
            for s, row in enumerate(nxt):
                if row:
                    t[s, list(row)] = np.fromiter(row.values(), np.int32, len(row)) * width
            self.tables.append(t.ravel())

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [texts, labels], cleaned lengths) of lower-cased texts."""
        c, offs = _clean(buf, offsets)
        c = self.code[c].astype(np.int32)
        n = len(offs) - 1
        lens = np.diff(offs)
        segs = -(-lens // SEGMENT)
        doc = np.repeat(np.arange(n), segs)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
        start = offs[:-1][doc] + within * SEGMENT
        seglen = np.minimum(SEGMENT, offs[1:][doc] - start)
        order = np.argsort(-seglen, kind="stable")
        start, seglen, doc = start[order], seglen[order], doc[order]
        phrases = np.zeros((n, len(self.labels)), np.int64)
        if not len(doc):
            return phrases, lens
        active = np.searchsorted(-seglen, -np.arange(seglen[0]), "left")
        state = [np.zeros(len(doc), np.int32) for _ in self.tables]
        breaks = [np.ones(len(doc), np.int32) for _ in self.tables]
        for t, m in enumerate(active):
            col = c[start[:m] + t]
            for k, table in enumerate(self.tables):
                v = table.take(state[k][:m] + col)
                neg = v >> 31
                state[k][:m] = v ^ neg
                breaks[k][:m] -= neg
        for k in range(len(self.tables)):
            phrases[:, k] = np.bincount(doc, breaks[k], n)
        return phrases, lens


_cached: dict[int, CrossParser] = {}
clear_after_task(_cached.clear)


def _judge(sample: dict[str, str], texts: pa.Array) -> tuple[list[str], np.ndarray]:
    key = hash(tuple(sorted(sample.items())))
    if key not in _cached:
        _cached.clear()
        _cached[key] = CrossParser(sample)
    parser, n = _cached[key], len(texts)
    labels, scores = np.full(n, "und", object), np.zeros(n)
    if not parser.labels:
        return labels.tolist(), scores
    buf, offsets = text_buffers(pc.utf8_lower(texts))
    for i, j in slices(offsets, _BYTES_AT_ONCE):
        part = offsets[i : j + 1]
        raw = buf[part[0] : part[-1]]
        ascii_letter = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
        sure = np.diff(ascii_letter[part - part[0]]) > 0
        for k in np.flatnonzero(~sure & (np.diff(part) > 0)):
            sure[k] = any(map(str.isalpha, raw[part[k] - part[0] : part[k + 1] - part[0]].tobytes().decode()))
        counts, _ = parser.count(buf, part)
        best = counts.argmin(1)
        least = counts[np.arange(j - i), best].astype(float)
        if len(parser.labels) > 1:
            second = np.partition(counts, 1, 1)[:, 1]
            score = 1 - least / np.maximum(second, 1)
        else:
            score = np.ones(j - i)
        labels[i:j] = np.where(sure, np.array(parser.labels, object)[best], "und")
        scores[i:j] = np.where(sure, score, 0.0)
    return labels.tolist(), scores


def identify(docs: DataFrame, sample: dict[str, str], text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted label and a score: 1 - phrases of the winner / of the runner-up."""
    rows = docs.drop(label_out, score_out)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = _judge(sample, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, label_out, score_out])

    schema = T.StructType([*rows.schema.fields, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)
