"""Secret scans: fixed patterns, plus random-looking tokens under false-discovery control.

Every run of 16 or more of `A-Z a-z 0-9 + / _ = -` with a letter is a test. Its encoding is inferred: the smallest
of ENCODINGS that can have made it. A battery of three tests asks whether that encoding made it at random:
chi-squared of the alphabet's use, the runs of character classes, and the correlation of neighbours. Their
p-values are combined by Fisher's method, with Brown's allowance for dependence (`battery`). Random tokens
pass, patterned ones do not; but of 16 to 32 characters the battery alone cannot tell words from random
ones, as it knows nothing of words. So a second p-value says how likely ordinary writing is to look so
random, by a likelihood ratio (`writing_p`). Power depends on length, so both are put under Benjamini-Hochberg control
within each length class, over the whole corpus, letters-only tokens apart: a token is reported if writing is
refuted and randomness is not. A run of more than BLOCK characters is tested in even blocks, each with a
verdict and a span of its own, to its end.

Defined results: null text is empty; empty text has no spans. Repeated rows are scanned alike and
each counts as a test. Equal p-values of a class are accepted or refused together. Very long
texts are scanned whole. An empty table gives no rows. Other columns are not read by `scan`, so they
cannot clash; `redact` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, exp, log, log2, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, tidy
from .words import slices, text_buffers

# The patterns that the scan must agree with.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 16

_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
#: Upper ends of the length classes, and the false-discovery rate within each.
LENGTH_CLASSES, FDR = (19, 23, 31, 47, 79, 1 << 30), 0.001
#: The rate at which the battery refutes randomness within each.
BATTERY_FDR = 0.01
#: Longer runs are cut into blocks of at most so many characters (and at least half as many).
BLOCK = 256
#: -log10 p is counted in bins of 1/BIN up to BINS.
BIN, BINS = 4, 160


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars.encode())] = True
    return m


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN_BYTES = _mask(_DIGITS + _UPPER + _LOWER + "+/_=-")
_HEX_BYTES = _mask(_DIGITS + "abcdef")
_ASSIGN_BYTES = _mask(":=")


def _has_run(buf: np.ndarray, offsets: np.ndarray, mask: np.ndarray, least: int) -> np.ndarray:
    """Which texts hold a run of at least so many bytes of the mask (runs may be overstated at text edges)."""
    on = mask[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    begin = begin[end - begin >= least]
    hit = np.zeros(len(offsets) - 1, bool)
    at = np.searchsorted(offsets, begin, "right") - 1
    hit[at[at < len(hit)]] = True
    # a run over a text edge: count the texts that it reaches
    for b, e in zip(begin.tolist(), end[end - edge[::2] >= least].tolist(), strict=True):
        i = int(np.searchsorted(offsets, b, "right")) - 1
        while i + 1 < len(hit) and offsets[i + 1] < e:
            i += 1
            hit[i] = True
    return hit


#: Encodings, smallest first: (name, alphabet, bits that a token of it pays for the choice; 2^-bits sum to less than 1).
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", 2.2),
    ("hex", _DIGITS + "ABCDEF", 2.2),
    ("lower", _LOWER, 5.3),
    ("upper", _UPPER, 5.3),
    ("base32", _UPPER + "234567", 2.2),
    ("base36", _LOWER + _DIGITS, 5.3),
    ("letters", _UPPER + _LOWER, 5.3),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 2.2),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", 5.3),
)
#: Correlation of the logarithms of two p-values that Fisher's sum allows for.
DEPENDENCE = 0.1
_FACTORIAL = (1, 1, 2, 6)


def encoding(token: str) -> tuple[str, str, float]:
    """The smallest encoding that can have made the token (any other: base64)."""
    used = set(token.rstrip("="))
    return next((e for e in ENCODINGS if used <= set(e[1])), ENCODINGS[-2])


def _upper_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def chi_squared_p(s: str, alphabet: str) -> float:
    """Chance that random characters use the alphabet as unevenly as s: Wilson and Hilferty's root of a gamma variable
    with the exact mean and variance of the statistic."""
    n, k = len(s), len(alphabet)
    x = sum(s.count(c) ** 2 for c in set(s)) * k / n - n
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    shape = mean * mean / var
    return _upper_tail(((x / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * sqrt(shape))


def runs_p(s: str, alphabet: str) -> float:
    """Chance of so odd a number of runs of character classes, more or fewer; 1 if the alphabet has one class."""
    n, sizes = len(s), {}
    for c in alphabet:
        sizes[_CLASS[c]] = sizes.get(_CLASS[c], 0) + 1
    share = [v / len(alphabet) for v in sizes.values()]
    change = 1 - sum(x * x for x in share)
    if change == 0:
        return 1.0
    both = sum(x * (1 - x) ** 2 for x in share)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change)
    changes = sum(_CLASS.get(a) != _CLASS.get(b) for a, b in zip(s, s[1:], strict=False))
    return min(1.0, 2 * _upper_tail(max(0.0, abs(changes - (n - 1) * change) - 0.5) / sqrt(var)))


def serial_p(s: str, alphabet: str) -> float:
    """Chance of so large a correlation of neighbours' places in the alphabet, positive or negative."""
    k = len(alphabet)
    x = [alphabet.find(c) - (k - 1) / 2 for c in s]
    r = sum(a * b for a, b in zip(x, x[1:], strict=False)) / ((k * k - 1) / 12)
    return min(1.0, 2 * _upper_tail(abs(r) / sqrt(len(s) - 1)))


def battery(token: str) -> float:
    """Combined p-value of the three tests: low if the token's encoding did not make it at random."""
    s = token.rstrip("=")
    if len(s) < 4:
        return 1.0
    alphabet = encoding(s)[1]
    fisher = -2 * sum(log(max(p, 1e-300)) for p in (chi_squared_p(s, alphabet), runs_p(s, alphabet), serial_p(s, alphabet)))
    # Brown: the sum as a scaled chi-squared variable; its even degrees of freedom give the tail in closed form
    scale = 1 + 2 * DEPENDENCE
    half, degrees = fisher / scale / 2, 6 / scale
    low, part = int(degrees // 2), degrees / 2 - int(degrees // 2)
    tail = lambda m: exp(-half) * sum(half**i / _FACTORIAL[i] for i in range(m))
    return min(1.0, (1 - part) * tail(low) + part * tail(low + 1))


#: Ordinary writing: how often letters occur (German, English, French and Spanish pooled, in
#: thousandths), signs between words, and the chance that a character's class changes to the next.
#: The chance is that of short words joined by signs and numbers, above that of plain text.
_LETTERS = dict(zip(_LOWER, (91, 16, 33, 43, 152, 14, 18, 28, 73, 3, 6, 48, 27, 78, 58, 22, 4, 67, 72, 70, 39, 11, 10, 3, 8, 6), strict=True))
_SIGNS = {"-": 0.3, "_": 0.3, "/": 0.3, "+": 0.05, "=": 0.05}
TEXT_CHANGE = 0.3
#: How readily writing copies itself (the follower of an earlier like character) or counts on
#: (the same character again, or one step from the last or the last but one).
TEXT_COPY, TEXT_ORDER = 0.25, 0.15
_USE = {c: log2(0.1) for c in _DIGITS} | {c: log2(p) for c, p in _SIGNS.items()}
_USE |= {x: log2(n / sum(_LETTERS.values())) for c, n in _LETTERS.items() for x in (c, c.upper())}
_CLASS = {c: k for k, chars in enumerate((_DIGITS, _UPPER, _LOWER, "+/_=-")) for c in chars}


def writing_p(token: str) -> float:
    """Chance that ordinary writing looks as random as the token.

    A likelihood ratio of writing (how often it uses characters, changes their class, and follows what came before) against
    the encoding; the chance under writing that such a ratio falls below x is at most x. Linear, over all
    characters.
    """
    s = token.rstrip("=")
    n = len(s)
    if n < 4:
        return 1.0
    _, alphabet, choice = encoding(s)
    k = len(alphabet)
    stay, change = log2(1 - TEXT_CHANGE), log2(TEXT_CHANGE / 3)
    bits = choice + n * log2(k) - 2 + _USE[s[0]]
    followers: dict[str, dict[str, int]] = {}
    for i in range(1, n):
        c, last = s[i], s[i - 1]
        written = 2 ** (_USE[c] + (stay if _CLASS[c] == _CLASS[last] else change))
        code = ord(c)
        steps = [ord(last) + d for d in (-1, 0, 1)] + ([ord(s[i - 2]) + d for d in (-1, 1)] if i > 1 else [])
        mixed = TEXT_ORDER * steps.count(code) / len(steps)
        seen = followers.setdefault(last, {})
        if seen:
            mixed += TEXT_COPY * seen.get(c, 0) / sum(seen.values())
        mixed += (1 - TEXT_ORDER - (TEXT_COPY if seen else 0)) * written
        seen[c] = seen.get(c, 0) + 1
        bits += log2(mixed)
    return 2.0 ** max(-1000.0, min(0.0, bits))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def blocks(start: int, end: int) -> list[tuple[int, int]]:
    """The even blocks of a run; one if it is short."""
    n = -(-(end - start) // BLOCK)
    cuts = [start + i * (end - start) // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, class, bins of -log10 of writing_p and of battery) of the tokens' blocks outside the base spans.

    There are two classes for each of LENGTH_CLASSES: tokens of letters alone, and others.
    """
    bin_of = lambda p: min(BINS, int(-log10(max(p, 1e-300)) * BIN))
    out = []
    for m in _TOKEN.finditer(text):
        if any(c.isalpha() for c in m[0]):
            others = int(not m[0].isalpha())
            for start, end in blocks(m.start(), m.end()):
                if not any(b < end and start < e for b, _, e in base):
                    length = next(i for i, most in enumerate(LENGTH_CLASSES) if end - start <= most)
                    token = text[start:end]
                    out.append((start, end, 2 * length + others, bin_of(writing_p(token)), bin_of(battery(token))))
    return out


_SPAN = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
_CAND = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("class", pa.int32()), ("bin", pa.int32()), ("odd", pa.int32())]))
_FOUND = "base array<struct<s:bigint,k:int,e:bigint>>, cand array<struct<s:bigint,e:bigint,class:int,bin:int,odd:int>>"


def _scan_column(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    buf, offsets = text_buffers(texts)
    base: list[list] = [[] for _ in range(len(texts))]
    cand: list[list] = [[] for _ in range(len(texts))]
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        raw = buf[offsets[i] : offsets[j]]
        seen = _has_run(raw, part, _ASSIGN_BYTES, 1) | _has_run(raw, part, _HEX_BYTES, MIN_HEX)
        seen |= _has_run(raw, part, _TOKEN_BYTES, MIN_RANDOM)
        if b"AKIA" in raw.tobytes():
            seen |= _has_run(raw, part, _TOKEN_BYTES, MIN_ACCESS)
        for d in np.flatnonzero(seen):
            text = raw[part[d] : part[d + 1]].tobytes().decode()
            spans = base_spans(text)
            base[i + d] = [dict(s=s, k=k, e=e) for s, k, e in spans]
            cand[i + d] = [dict(zip(("s", "e", "class", "bin", "odd"), c, strict=True)) for c in candidates(text, spans)]
    return pa.array(base, _SPAN), pa.array(cand, _CAND)


def _with_spans(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """rows[keep] with columns base and cand."""
    cols = rows.select(*keep, F.col(text_col).alias("scan__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cand = _scan_column(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], base, cand], [*b.schema.names[: len(keep)], "base", "cand"])

    return cols.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), _FOUND]))


def _refuted(counts: np.ndarray, rate: float) -> int:
    """Benjamini-Hochberg over tests counted by bin: the least bin whose hypotheses are refuted."""
    at_least = counts[::-1].cumsum()[::-1]
    for b in range(BINS + 1):  # p of the bin's lower edge against rate * rank / tests
        if at_least[b] and 10 ** (-b / BIN) <= rate * at_least[b] / counts.sum():
            return b
    return BINS + 1


def thresholds(found: DataFrame, fdr: float = FDR) -> list[tuple[int, int]]:
    """For each class the least bin at which writing is refuted, and that at which randomness is, over all tests of the class.

    found has the column cand. Only the counts of 2 x len(LENGTH_CLASSES) x 2 x (BINS + 1) cells reach the driver.
    """
    tests = found.select(F.explode("cand").alias("c")).select("c.class", F.explode(F.array(*(F.struct(F.lit(i).alias("test"), F.col(f"c.{b}").alias("bin")) for i, b in enumerate(("bin", "odd"))))).alias("t"))
    counts = np.zeros((2 * len(LENGTH_CLASSES), 2, BINS + 1), np.int64)
    for r in tests.groupBy("class", "t.test", "t.bin").count().collect():
        counts[r["class"], r["test"], r["bin"]] = r["count"]
    return [(_refuted(c[0], fdr), _refuted(c[1], BATTERY_FDR)) for c in counts]


def _accepted(bars: list[tuple[int, int]]) -> Column:
    least, most = (F.array(*[F.lit(b[i]) for b in bars]) for i in range(2))
    bar = lambda bars, c: F.element_at(bars, c["class"] + 1)
    return F.transform(
        F.filter("cand", lambda c: (c["bin"] >= bar(least, c)) & (c["odd"] < bar(most, c))),
        lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS) - 1).cast("int").alias("k"), c["e"].alias("e")),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, base spans, all spans) per row; a span is a struct (s start, k kind number, e end), sorted."""
    found = materialise(_with_spans(docs, text_col, [id_col]), "secret-spans")
    return found.select(id_col, "base", F.array_sort(F.concat("base", _accepted(thresholds(found, fdr)))).alias("spans"))


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """docs with every span of the text replaced by the mask; all columns and rows stay.

    The texts are scanned twice, first for the thresholds and then to be rewritten, so that no
    copy of them is kept. Null text stays null.
    """
    bars = thresholds(_with_spans(docs, text_col, []), fdr)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            base, cand = _scan_column(col)
            changed = {}
            for i, (xs, ys) in enumerate(zip(base.to_pylist(), cand.to_pylist(), strict=True)):
                found = [(y["s"], y["e"]) for y in ys if y["bin"] >= bars[y["class"]][0] and y["odd"] < bars[y["class"]][1]]
                spans = sorted([(x["s"], x["e"]) for x in xs] + found)
                if spans:
                    text, out, end, random = col[i].as_py(), [], 0, set(found)
                    for k, (s, e) in enumerate(spans):
                        # touching blocks of a run get one mask
                        if s > end or (s == end and not (k and {spans[k - 1], (s, e)} <= random)):
                            out += [text[end:s], mask]
                        end = max(end, e)
                    changed[i] = "".join(out) + text[end:]
            if changed:
                col = pa.array([changed.get(i, v) for i, v in enumerate(col.to_pylist())], col.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1 :]], b.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
