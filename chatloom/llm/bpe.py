"""Byte-level BPE through a sentencepiece model that is serialised from a rank vocabulary.

Each byte is mapped to one printable character, so the vocabulary's byte strings become pieces.
A piece's score is its negative rank: sentencepiece merges the best-scored neighbours first, as
rank-ordered BPE does. Texts are cut into pre-tokens by the vocabulary's pattern; each distinct
pre-token is encoded once and looked up after that. Decoding starts from the ids alone.

Defined results: null text is empty: no ids, an empty byte string. Repeated rows are encoded
alike. Very long texts are cut by the pattern like others; only the ids of about SLICE bytes of
text (or of one longer text) are held. An empty table gives no rows. `encode_documents` and
`decode_documents` replace a column named like their output; `token_digests` keeps the id only,
so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import clear_after_task, tidy
from .words import slices, text_buffers


def byte_chars() -> list[str]:
    """One character for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_CHARS = byte_chars()
_TO_CHARS = {b: c for b, c in enumerate(_CHARS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One protocol-buffer field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is <unk>, piece i the token of the i-th rank."""
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token in sorted(ranks, key=ranks.__getitem__):
        piece = "".join(_CHARS[b] for b in token)
        out.append(_field(1, _field(1, piece) + _field(2, -float(ranks[token])) + _field(3, normal)))
    # trainer: model type, vocabulary size, then ids of unk, bos, eos and pad
    none = 2**64 - 1
    out.append(_field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)))
    # normaliser: identity, no dummy prefix, white space kept as it is
    out.append(_field(3, _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)))
    return b"".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Characters on which the standard library's classes agree with Unicode's letter, number and
#: white-space classes; texts of other characters go through the slower engine.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]")


def pretokenizer(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern. \\s is Unicode white space, which leaves U+001C..U+001F out."""
    exact = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"[^\p{White_Space}]").replace(r"\s", r"\p{White_Space}")
    full = regex.compile(exact).findall
    plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
    if r"\p" in plain.pattern:
        return full
    fast = plain.findall
    return lambda text: full(text) if _PLAIN.search(text) else fast(text)


class Codec:
    """Encodes and decodes by ranks; keeps up to CACHE bytes of distinct pre-tokens and their ids, ENTRY of them
    for the objects of each."""

    CACHE, ENTRY, LONG = 24 << 20, 160, 256

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        order = sorted(ranks, key=ranks.__getitem__)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        # by piece number; 0 is <unk>
        self.ids = [-1, *(ranks[t] for t in order)]
        self.digits = [b"%d" % i for i in self.ids]
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.bytes_of_digits = {b"%d" % r: t for t, r in ranks.items()}
        self.find = pretokenizer(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces_of(self, tokens: list[str]) -> list[list[int]]:
        """Piece numbers of each pre-token."""
        blank, mapped = _CHARS[32], []
        for t in tokens:
            plain = t.isascii() and t.isprintable()
            mapped.append(t.replace(" ", blank) if plain else "".join(map(_TO_CHARS.__getitem__, t.encode())))
        return self.sp.encode(mapped, out_type=int, num_threads=1) if mapped else []

    def encode(self, text: str) -> list[int]:
        return [self.ids[p] for row in self.pieces_of(self.find(text)) for p in row]

    def _learn(self, tokens: set[str]) -> None:
        """Pre-tokens with their ids as decimal digits between blanks."""
        new = list(tokens)
        for t, row in zip(new, self.pieces_of(new), strict=True):
            self.known[t] = ids = b" ".join(map(self.digits.__getitem__, row))
            self.held += self.ENTRY + len(t) + len(ids)

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the bytes that the ids stand for) of each text."""
        found = [self.find(t or "") for t in texts]
        if self.held > self.CACHE:
            self.forget()
        new = set().union(*found).difference(self.known)
        self._learn(new)
        for tokens in found:
            ids = b" ".join(map(self.known.__getitem__, tokens))
            each = ids.split()
            decoded = b"".join(map(self.bytes_of_digits.__getitem__, each))
            yield len(each), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
        for t in new:
            if len(t) > self.LONG:
                self.held -= self.ENTRY + len(t) + len(self.known.pop(t))


_codecs: dict[tuple[str, str], Codec] = {}


clear_after_task(_codecs.clear)


def codec(path: str, pattern: str) -> Codec:
    """The task's codec."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, then decoded again."""
    rows = docs.select(id_col, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i, j in slices(text_buffers(b.column(1))[1]):
                part = b.slice(i, j - i)
                out = [*zip(*c.digests(part.column(1).to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_out: str = "ids") -> DataFrame:
    """docs with the array of ids of every whole text."""
    rows = docs.drop(ids_out)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, ids_out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(ids_out, T.ArrayType(T.IntegerType()))]))


def decode_documents(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_out: str = "decoded") -> DataFrame:
    """rows with the byte string that the ids stand for (null ids: empty)."""
    rows = rows.drop(bytes_out)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(ids or []) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, bytes_out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(bytes_out, T.BinaryType())]))
